"""Column expressions built once per process.

A column that only names other columns can be used in any number of plans; the larger ones here take a second to put
together from Python, which matters when many short queries use them.
"""

import functools

from pyspark import SparkContext


def built_once(build):
    """Keeps what ``build`` returns, per arguments, for as long as the same JVM is in use."""
    kept: dict = {}

    @functools.wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get
