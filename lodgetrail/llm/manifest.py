"""A Merkle manifest of a dataset: one digest per row, per source and for the whole, with proofs.

Rows become leaves, the leaves of a source a tree of fanout ``FANOUT``, and the subroots of all sources a tree of the same
kind. Every level is one aggregation: conditional aggregates spread a parent's children into ``FANOUT`` columns, one per
slot. The columns put one behind the other and hashed are the parent; all of them but a child's own are its siblings.
A parent never has more than ``FANOUT`` rows to gather, whatever the size of its source, and each level has a sixteenth of
the rows of the one below. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail.operators.ordered import placed
from lodgetrail.session import stage

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SLOTS = [f"s{k}" for k in range(FANOUT)]
_PATH = "array<struct<before:string,after:string>>"


def leaf_of(values: Sequence[Column]) -> Column:
    """The SHA-256, in lower-case hex, of a row's values: each is ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    parts = []
    for v in values:
        shown = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _group_key(source: Column) -> Column:
    """A source as a string that sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


@dataclass(frozen=True)
class Tree:
    """The trees of some groups. ``pivots[k]`` holds the parents of level ``k``'s nodes, a column per slot; ``tops`` each
    group's last node with its level."""

    nodes: DataFrame
    pivots: tuple[DataFrame, ...]
    tops: DataFrame
    carry: tuple[str, ...]


def build(nodes: DataFrame, carry: Sequence[str] = ()) -> Tree:
    """The trees over ``nodes``: ``grp`` (long), ``i`` (place in the group, from 0), ``n`` (nodes of the group), ``digest``
    (binary). ``carry`` names columns of the nodes that come out again with their proofs.
    """
    nodes = stage(nodes.select("grp", "i", "n", "digest", *carry), "merkle-nodes")
    n = nodes.agg(F.max("n")).first()[0] or 0
    held, pivots, tops = nodes, [], nodes.where("n = 1").select("grp", "digest", F.lit(0).alias("level"))
    extra = tuple(carry)
    while n > 1:
        child = F.struct("digest", *extra)
        slot = F.pmod("i", F.lit(FANOUT))
        spread = held.where("n > 1").groupBy("grp", F.floor(F.col("i") / FANOUT).alias("i"), F.ceil(F.col("n") / FANOUT).alias("n"))
        pivot = stage(spread.agg(*(F.max(F.when(slot == k, child)).alias(s) for k, s in enumerate(_SLOTS))), "merkle-level")
        pivots.append(pivot)
        joined = F.sha2(F.concat_ws("", *(_hex(F.col(f"{s}.digest")) for s in _SLOTS)), 256)
        held = pivot.select("grp", "i", "n", F.unhex(joined).alias("digest"))
        tops = tops.unionByName(held.where("n = 1").select("grp", "digest", F.lit(len(pivots)).alias("level")))
        extra, n = (), -(-n // FANOUT)
    return Tree(nodes, tuple(pivots), stage(tops, "merkle-tops"), tuple(carry))


def _children(parents: DataFrame, carry: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per child: ``i``, its digest and carried columns, and ``path``, its siblings put before the parent's path."""
    shown = [F.coalesce(_hex(F.col(f"{s}.digest")), F.lit("")).alias(f"h{k}") for k, s in enumerate(_SLOTS)]
    wide = parents.select("*", *shown)

    def joined(slots: range) -> Column:
        return F.concat(*(F.col(f"h{k}") for k in slots)) if len(slots) else F.lit("")

    each = [F.when(F.col(s).isNotNull(), F.struct(
        (F.col("i") * FANOUT + k).alias("i"), F.col(s).alias("child"),
        F.struct(joined(range(k)).alias("before"), joined(range(k + 1, FANOUT)).alias("after")).alias("own"))) for k, s in enumerate(_SLOTS)]
    rows = wide.select("grp", "path", *keep, F.explode(F.array_compact(F.array(*each))).alias("c"))
    path = F.concat(F.array("c.own"), F.col("path")).cast(_PATH)
    return rows.select("grp", F.col("c.i").alias("i"), "c.child.digest", *(F.col(f"c.child.{x}") for x in carry), path.alias("path"), *keep)


def proofs(tree: Tree, tops: DataFrame) -> DataFrame:
    """Every node of the lowest level with ``digest``, its carried columns and ``path``.

    ``tops`` has ``grp``, ``level`` and ``path``, what each group's path goes on with above its top, and may have more columns,
    which pass through. A path lists, from the node upwards, the siblings' digests before and after the own slot.
    """
    keep = [c for c in tops.columns if c not in ("grp", "level", "path")]
    above = None
    for k in range(len(tree.pivots), 0, -1):
        here = tops.where(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("i"), "path", *keep)
        above = here if above is None else here.unionByName(above.select("grp", "i", "path", *keep))
        above = _children(tree.pivots[k - 1].join(above, ["grp", "i"]), tree.carry if k == 1 else (), keep)
    alone = tree.nodes.where("n = 1").join(tops.where("level = 0").drop("level"), "grp")
    alone = alone.select("grp", "i", "digest", *tree.carry, "path", *keep)
    return alone if above is None else alone.unionByName(above)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) and its path lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def siblings_digest(path: Column) -> Column:
    """The SHA-256 of all digests of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """The root (None of an empty table), ``sources`` (``source``, ``rows``, ``subroot``) and ``proofs`` (key, ``leaf``, ``subroot``,
    ``path`` and what was carried)."""

    root: str | None
    sources: DataFrame
    proofs: DataFrame


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", source: str = "source", carry: dict[str, Column] | None = None) -> Manifest:
    """The Merkle manifest of a table.

    Leaves of a source ascend by ``key`` (null first), rows with one key by their leaf; sources ascend bytewise, null
    first. Every row is a leaf, repeated rows too. ``carry`` names expressions over the rows that come out with the
    proofs. Null and empty values differ. Columns that are no field are not part of the digest and may have any name.
    """
    rows = docs.select(
        docs[key].alias("_key"), _group_key(docs[source]).alias("_source"), F.unhex(leaf_of([docs[f] for f in fields])).alias("digest"),
        *(c.alias(f"_c_{n}") for n, c in (carry or {}).items()))
    order = [F.col("_source"), F.col("_key").asc_nulls_first(), F.col("digest")]
    ranked = stage(placed(stage(rows, "merkle-leaves"), *order), "merkle-ranked")
    groups = stage(ranked.groupBy("_source").agg(F.min("place").alias("grp"), F.count(F.lit(1)).alias("n")), "merkle-sources")
    held = ["_key", *(f"_c_{n}" for n in carry or {})]
    nodes = ranked.join(groups, "_source").select("grp", (F.col("place") - F.col("grp")).alias("i"), "n", "digest", *held)
    tree = build(nodes, held)

    own = placed(tree.tops, F.col("grp"))
    upper = build(own.select(F.lit(0).cast("long").alias("grp"), (F.col("place") - 1).alias("i"), F.lit(tree.tops.count()).alias("n"), "digest", F.col("grp").alias("_grp"), F.col("level").alias("_level")), ["_grp", "_level"])
    top = upper.tops.first()
    start = upper.tops.select("grp", "level", F.array().cast(_PATH).alias("path"))
    subroots = stage(proofs(upper, start).select(F.col("_grp").alias("grp"), F.col("_level").alias("level"), "path", _hex(F.col("digest")).alias("subroot")), "merkle-subroots")

    found = proofs(tree, subroots).select(
        F.col("_key").alias(key), _hex(F.col("digest")).alias("leaf"), "subroot", "path", *(F.col(f"_c_{n}").alias(n) for n in carry or {}))
    named = F.when(F.col("_source") != "-", F.substr("_source", F.lit(2)))
    sources = groups.join(subroots, "grp").select(named.alias("source"), F.col("n").alias("rows"), "subroot")
    return Manifest(bytes(top.digest).hex() if top else None, sources, found)
