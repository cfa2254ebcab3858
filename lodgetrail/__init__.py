"""lodgetrail: rental-listing tracking as Spark DataFrame transformations.

Every public function takes and returns a ``DataFrame`` or builds a ``Column``;
nothing runs until the caller asks for an action.
"""

__version__ = "0.1.0"
