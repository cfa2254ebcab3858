"""Secret scanning: candidates, and a random forest that removes false positives.

A candidate is a run of at least 16 letters, digits and ``+/=_-`` that holds a digit; a word can have many (minified JSON
is one word). Its features are its length, how often neighbouring characters change between digits, small and capital
letters, how much of it is covered by dictionary words, where it comes from, and what stands around it. The dictionary
is counted over all documents.

The tables at hand hold no labelled findings, so labels come from rules that only speak where they are sure: a value
assigned to a secret's name, a key with a provider's prefix and a line of a private PEM block are findings; a bare
number, a placeholder and dictionary words that nothing assigns or names are not. Other candidates are left to the forest. Only DataFrame functions and Spark ML are used.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail.llm.common import smallest, words_of
from lodgetrail.session import stage

_RUN = r"[A-Za-z0-9+/=_\-]{16,}"
#: Earlier parts of a value joined by dots, as in a JWT, and earlier name-value pairs of the same word.
_PARTS = r"(?<![A-Za-z0-9+/_\-])(?:[A-Za-z0-9+/_\-]{16,}+\.)+$"
_PAIRS = r"(?s)^.*[,;&{}|](?=[^,;&{}|]*[:=])"
_NAMES = "token|secret|passw|api_?-?key|auth|credential|private|access_?-?key"
_KEYS = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{20,}|[sr]k_(?:live|test)_[0-9A-Za-z]{8,}|xox[abeoprs]-[\w-]{10,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36})"
_PEM = r"(?s)-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----|\z)"
_PLACEHOLDER = "example|sample|dummy|placeholder|changeme|xxxx|your"
#: Labelled candidates the forest is grown on at most: those with the smallest hash.
FIT_ROWS = 50_000
#: A word is in the dictionary if at least this share of the documents, and two of them, hold it.
DICTIONARY_SHARE = 1e-4
THRESHOLD = 0.5
#: An unnamed candidate is surely harmless if this share of it is dictionary words.
PLAIN = 0.5
FEATURES = ("length", "changes", "digits", "capitals", "symbols", "varied", "covered", "source_rate", "named", "assigned", "quoted", "placeholder", "number", "known")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per candidate: ``key``, ``source``, ``place`` (word number), ``nth`` (run of the word), ``value``, and the text around it."""
    origin = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(origin, F.lit("")).alias("_source"), words_of(F.col(text)).alias("_words"),
                       F.when(F.contains(F.col(text), F.lit("-----BEGIN")), F.regexp_extract_all(F.col(text), F.lit(_PEM), F.lit(1))).alias("_pem"))
    # Places first, then what stands there: most texts have none.
    at = F.filter(F.transform("_words", lambda w, i: F.when((F.length(w) >= 16) & w.rlike("[0-9]") & w.rlike(_RUN), i)), lambda i: i.isNotNull())
    rows = rows.select("_key", "_source", "_pem", "_words", at.alias("_at")).where(F.size("_at") > 0)
    near = F.transform("_at", lambda i: F.struct(
        i.alias("place"), F.get("_words", i).alias("word"), F.get("_words", i - 1).alias("left1"), F.get("_words", i - 2).alias("left2"), F.get("_words", i + 1).alias("right")))
    found = rows.select("_key", "_source", "_pem", F.explode(near).alias("c")).select("_key", "_source", "_pem", "c.*")
    # All runs of the word and the gaps around them. A run gets the text in front of it back over two runs, so long words are not copied for each.
    found = found.withColumns({"_runs": F.regexp_extract_all("word", F.lit(_RUN), F.lit(0)), "_gaps": F.split("word", _RUN, -1)})
    each = F.transform("_runs", lambda run, k: F.struct(
        k.alias("nth"), run.alias("run"),
        F.concat_ws("", F.get("_gaps", k - 2), F.get("_runs", k - 2), F.get("_gaps", k - 1), F.get("_runs", k - 1), F.get("_gaps", k)).alias("front"),
        F.when(k <= 2, F.concat_ws(" ", "left2", "left1")).alias("left"), F.when(k == F.size("_runs") - 1, F.col("right")).alias("right"),
        F.concat_ws("", F.get("_gaps", k), F.get("_gaps", k + 1)).alias("edges"),
        F.coalesce(F.exists("_pem", lambda body: F.contains(body, run)), F.lit(False)).alias("pem")))
    found = found.select("_key", "_source", "place", F.explode(each).alias("c")).select("_key", "_source", "place", "c.*").where(F.col("run").rlike("[0-9]"))
    # In name=value the run may hold both.
    value = F.when(F.col("run").rlike("^[A-Za-z_-]+=+[^=]{8,}"), F.regexp_extract("run", "^[A-Za-z_-]+=+(.*)$", 1)).otherwise(F.col("run"))
    found = found.withColumn("value", value)
    found = found.withColumn("front", F.concat(F.regexp_replace("front", _PARTS, ""), F.expr("left(run, length(run) - length(value))")))
    found = found.withColumn("own", F.regexp_replace("front", _PAIRS, ""))
    before = F.concat_ws(" ", F.when(F.col("own") == F.col("front"), F.col("left")), "own")
    return found.select(F.col("_key").alias("key"), F.col("_source").alias("source"), "place", "nth", "value", "right", F.lower(before).alias("before"), "edges", "pem")


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """``piece``: the lower-cased words of 3 to 24 letters in at least ``DICTIONARY_SHARE`` of the documents, and in two.

    The share doesn't depend on how many documents or languages there are, so a value is covered alike at every size.
    """
    words = F.array_distinct(F.transform(words_of(F.col(text)), lambda w: F.regexp_extract(F.lower(w), r"^\p{P}*(\p{L}{3,24})\p{P}*$", 1)))
    counted = docs.select(F.explode(words).alias("piece")).where("piece <> ''").groupBy("piece").count()
    return counted.where(F.col("count") >= max(2, DICTIONARY_SHARE * docs.count())).select("piece")


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{pattern}]", "")) / F.length(value)


def describe(found: DataFrame, known: DataFrame) -> DataFrame:
    """Add the features of each candidate; ``known`` is the dictionary."""
    value = F.col("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    row = found.withColumns({
        "length": F.length(value).cast("double"), "changes": (runs - 1) / F.length(value),
        "digits": _share(value, "0-9"), "capitals": _share(value, "A-Z"), "symbols": _share(value, r"+/=_\-"),
        "varied": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "named": F.col("before").rlike(_NAMES).cast("double"), "assigned": F.col("before").rlike(r"[:=]\s*[\"'`(\[]*$").cast("double"),
        "quoted": F.col("edges").rlike("[\"'`]").cast("double"), "placeholder": F.lower(F.concat_ws(" ", "before", "value")).rlike(_PLACEHOLDER).cast("double"),
        "known": (F.col("pem") | value.rlike(_KEYS)).cast("double"), "number": (~value.rlike("[A-Za-z]")).cast("double"),
    })
    # Letters of the value that lie in dictionary words, by distinct value.
    pieces = found.select("value").distinct().select("value", F.explode(F.array_distinct(F.split(F.lower("value"), "[^a-z]+"))).alias("piece")).where(F.length("piece") >= 3)
    held = pieces.join(known, "piece").groupBy("value").agg(F.sum(F.length("piece")).alias("_held"))
    row = row.join(stage(held, "covered-values"), "value", "left").withColumn("covered", F.least(F.lit(1.0), F.coalesce("_held", F.lit(0)) / F.length("value"))).drop("_held")
    sure = F.when((F.col("known") == 1) & (F.col("placeholder") == 0), 1.0)
    sure = sure.when((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("number") == 0) & (F.col("placeholder") == 0) & (F.col("length") >= 20), 1.0)
    plain = (F.col("named") == 0) & (F.col("assigned") == 0) & (F.col("covered") >= PLAIN)
    sure = sure.when((F.col("number") == 1) | (F.col("placeholder") == 1) | plain, 0.0)
    return row.withColumn("label", sure)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Judge every candidate of every whole text.

    Returns ``key``, ``place`` (number of the word, from 0; a word with several candidates has a row for each), ``value``, ``score`` (0 to 1) and ``secret`` (score of at
    least ``THRESHOLD``). Null and empty texts have no candidate; repeated rows have theirs each; a missing or null
    source counts as the empty one; tables without candidates give no row. With labels of one kind only there is
    nothing to grow a forest on, and the sure rules alone decide.
    """
    # Staged before it is described: values and rows are both taken from it.
    seen = stage(candidates(docs, key, text, source), "candidates")
    found = stage(describe(seen, stage(dictionary(docs, text), "dictionary")), "described-candidates")
    # The origin's share of sure secrets; candidates are few against texts.
    rates = found.groupBy("source").agg((F.sum(F.when(F.col("label") == 1, 1).otherwise(0)) / F.count("*")).alias("source_rate"))
    found = stage(found.join(stage(rates, "source-rates"), "source"), "described")
    known = smallest(found.where("label IS NOT NULL"), F.xxhash64("value", "key", "place"), ["value", "key", "place", "nth"], FIT_ROWS)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    known = stage(known, "labelled-findings")
    if known.select("label").distinct().count() < 2:
        score = F.coalesce("label", F.lit(0.0))
        judged = found
    else:
        forest = RandomForestClassifier(numTrees=40, maxDepth=6, seed=7, labelCol="label", featuresCol="features").fit(assemble.transform(known))
        judged = forest.transform(assemble.transform(found))
        # A known form is a finding wherever it stands; the forest judges the others.
        score = F.when((F.col("known") == 1) & (F.col("placeholder") == 0), 1.0).otherwise(vector_to_array("probability")[1])
    return judged.select(F.col("key").alias(key), "place", "value", score.alias("score"), (score >= THRESHOLD).alias("secret"))


def redact(docs: DataFrame, findings: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace the secrets found in each text by ``mark``, longest first, wherever the text holds them; other rows stay as they are.

    Null texts stay null, and rows that repeat a key get the secrets of all of them replaced. All columns pass through;
    one named ``_values`` is not possible.
    """
    values = findings.where("secret").groupBy(key).agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("_values"))
    joined = docs.join(stage(values, "secrets"), key, "left")
    clean = F.aggregate("_values", F.col(text), lambda t, v: F.replace(t, v, F.lit(mark)))
    return joined.withColumn(text, F.when(F.col("_values").isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)
