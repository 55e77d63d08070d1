"""Training-data operators and the corpus pipeline.

One module per operator; :mod:`queries` holds the registered ``opN_*`` queries
and :mod:`models` the small learners (logistic, boosted trees, isotonic) that
are fitted on the driver from bounded samples or partition-summed statistics.
Nothing else in the package imports this subpackage.
"""
