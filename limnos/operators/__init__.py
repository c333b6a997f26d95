"""DataFrame operators (``DataFrame -> DataFrame``; column names are arguments).

quality     projection, sparse-column drop, missing report, profile, fills, filters
reshape     counts, top categories, first/last per group, pivots, describe, top-k, samples
joins       key joins (optionally null-safe), dedup-then-join, semi/anti, key overlap, date fan-out
spatial     nearest-neighbour join without a cross join; nearest named place
stats       exact quantiles by histogram bracketing
features    derived seasonal/climate features, median imputer, standardiser, scoring matrix
regression  hash and exact splits, grouped OLS from Gram sums, fold-subtracted CV, metrics
learners    Spark ML model families, training loop, metrics table, persistence
timeline    scoring over dates, recent-score calendar
grid        map grid, IDW interpolation, hull mask, render table, point enrichment
"""
