"""DataFrame-level operators: DataFrame in, DataFrame out, usable with ``df.transform``.

Operators that group take ``keys``: extra grouping columns such as model, split and run, so that one call
covers all of them in one pass.
"""
