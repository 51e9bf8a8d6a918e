"""Statistics and histograms of event values by type."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagoon.operators import hdr, stats
from lagoon.sources.tables import SAMPLES_SQL, samples

G = ["g"]
BITS = 5


def _hist(s, d):
    return hdr.record(samples(s, d), G, "x", BITS)


def _split(s, d):
    return samples(s, d).where("g IN ('click', 'view')").withColumn("side", F.col("g") == "click")


QUERIES = {
    "pctl_floor": lambda s, d: stats.facade(samples(s, d), G, "x"),
    "pctl_sweep": lambda s, d: stats.sweep(samples(s, d), G, "x", 0.5, 0.999, 0.05),
    "mean_trunc": lambda s, d: stats.means(samples(s, d), G, "x"),
    "moments": lambda s, d: stats.moments(samples(s, d), G, "x"),
    "iqr": lambda s, d: stats.iqr(samples(s, d), G, "x"),
    "mad": lambda s, d: stats.mad(samples(s, d), G, "x"),
    "tail_expectation": lambda s, d: stats.tail_expectation(samples(s, d), G, "x", 0.95),
    "hill": lambda s, d: stats.hill(samples(s, d), G, "x", 50),
    "tail_fatness": lambda s, d: stats.tail_fatness(samples(s, d), G, "x"),
    "jitter": lambda s, d: stats.jitter(samples(s, d), G, "x", "seq", F.call_function("shiftright", "seq", F.lit(12))),
    "cdf_log2": lambda s, d: stats.log2_cdf(samples(s, d), G, "x"),
    "ks_distance": lambda s, d: stats.ks_distance(_split(s, d), "side", "x"),
    "cohens_d": lambda s, d: stats.cohens_d(_split(s, d), "side", "x"),
    "bootstrap_ci": lambda s, d: stats.bootstrap_ci(samples(s, d), G, "x", 0.99, 20, 0.9, 42),
    "hdr_counts": _hist,
    "hdr_quantile": lambda s, d: hdr.quantiles(_hist(s, d), G, BITS, {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}),
    "hdr_rank_of_value": lambda s, d: hdr.share_at_or_below(_hist(s, d), G, BITS, 5000),
    "hdr_summary": lambda s, d: hdr.summary(_hist(s, d), G, BITS),
    "hdr_merge": lambda s, d: hdr.merge(hdr.record(samples(s, d).where("seq % 2 = 0"), [], "x", BITS), hdr.record(samples(s, d).where("seq % 2 = 1"), [], "x", BITS)),
    "hdr_tagged": lambda s, d: hdr.quantiles(
        _hist(s, d).unionByName(hdr.record(samples(s, d), [], "x", BITS).withColumn("g", F.lit("(all)"))),
        G, BITS, {"p50": 0.5, "p99": 0.99},
    ),
    "hdr_co_backfill": lambda s, d: hdr.record(hdr.backfill(samples(s, d).select("g", "x"), "x", 1000), G, "x", BITS),
    "hdr_linear": lambda s, d: hdr.linear_bands(_hist(s, d), G, BITS, 1000),
    "hdr_log": lambda s, d: hdr.log_bands(_hist(s, d), G, BITS),
    "hdr_pct_iter": lambda s, d: hdr.percentile_steps(_hist(s, d), G, BITS, 10),
    "hdr_decay": lambda s, d: hdr.decayed(samples(s, d), G, "x", BITS, (F.lit(20000) - F.col("seq")).cast("double"), 5000.0).withColumn("c", F.round("c", 6)),
    "hdr_intervals": lambda s, d: hdr.intervals(samples(s, d), G, "ts", "x", BITS, "1 day"),
}

_RANKS = f"WITH {SAMPLES_SQL}, r AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS rk, count(*) OVER (PARTITION BY g) AS n FROM s)"


def _at(q: float, name: str) -> str:
    return f"max(x) FILTER (WHERE rk = least(n, CAST(floor(CAST({q!r} AS DOUBLE) * n) AS BIGINT) + 1)) AS {name}"


_MOMENTS = f"""WITH {SAMPLES_SQL}, c AS (SELECT g, CAST(sum(x) // count(x) AS BIGINT) AS mean, count(x) AS n FROM s GROUP BY g),
m AS (SELECT g, max(mean) AS mean, max(n) AS n, sum(pow(CAST(x - mean AS DOUBLE), 2)) AS s2, sum(pow(CAST(x - mean AS DOUBLE), 3)) AS s3, sum(pow(CAST(x - mean AS DOUBLE), 4)) AS s4 FROM s JOIN c USING (g) GROUP BY g),
d AS (SELECT *, CAST(round(sqrt(s2 / (n - 1))) AS BIGINT) AS stddev FROM m)
SELECT g, mean, stddev, round(stddev / CAST(mean AS DOUBLE), 6) AS cov, round((s3 / n) / pow(s2 / n, 1.5), 6) AS skewness, round((s4 / n) / ((s2 / n) * (s2 / n)) - 3, 6) AS kurtosis FROM d"""


def _bucket(x: str) -> str:
    """The bucket rule in SQL: the bit length is that of the binary text."""
    s = 1 << BITS
    return f"(CASE WHEN {x} < {s} THEN {x} ELSE (length(bin({x})) - {BITS}) * {s} + (({x} >> CAST(length(bin({x})) - {BITS} - 1 AS BIGINT)) % {s}) END)"


def _lower(i: str) -> str:
    s = 1 << BITS
    return f"(CASE WHEN {i} < {s} THEN {i} ELSE ({i} % {s} + {s}) << CAST({i} // {s} - 1 AS BIGINT) END)"


_H = f"WITH {SAMPLES_SQL}, h AS (SELECT g, CAST({_bucket('x')} AS BIGINT) AS bucket, count(*) AS c FROM s GROUP BY ALL), k AS (SELECT *, {_lower('bucket')} AS lo, sum(c) OVER (PARTITION BY g ORDER BY bucket) AS cum, sum(c) OVER (PARTITION BY g) AS total FROM h)"


def _hq(q: float, name: str) -> str:
    return f"CAST(min(lo) FILTER (WHERE cum >= greatest(1, floor(CAST({q!r} AS DOUBLE) * total))) AS BIGINT) AS {name}"


_GRID = [0.5]
while _GRID[-1] + 0.05 <= 0.999 + 1e-12:
    _GRID.append(_GRID[-1] + 0.05)

#: The generator's states by doubling, then the order statistics of 20 rounds of n draws.
_BOOTSTRAP = f"""WITH RECURSIVE {SAMPLES_SQL},
v AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM s),
z AS (SELECT g, max(n) AS n FROM v GROUP BY g),
p(j, a, c) AS (
  SELECT 0, CAST(6364136223846793005 AS UHUGEINT), CAST(1442695040888963407 AS UHUGEINT)
  UNION ALL SELECT j + 1, a * a % 18446744073709551616, (a + 1) * c % 18446744073709551616 FROM p WHERE (1 << j) <= (SELECT 20 * max(n) FROM z)),
d(j, k, a, c) AS (
  SELECT 0, CAST(0 AS BIGINT), CAST(1 AS UHUGEINT), CAST(0 AS UHUGEINT)
  UNION ALL SELECT d.j + 1, d.k + b.k * (1 << d.j), CASE b.k WHEN 1 THEN d.a * p.a % 18446744073709551616 ELSE d.a END, CASE b.k WHEN 1 THEN (d.c * p.a + p.c) % 18446744073709551616 ELSE d.c END
  FROM d JOIN p ON p.j = d.j, (VALUES (0), (1)) b(k)),
r AS (SELECT k, (a * 42 + c) % 18446744073709551616 AS state FROM d WHERE j = (SELECT max(j) + 1 FROM p) AND k > 0),
w AS (SELECT z.g, (r.k - 1) // z.n AS round, z.n, CAST(r.state % CAST(z.n AS UHUGEINT) AS BIGINT) AS place FROM z JOIN r ON r.k <= 20 * z.n),
o AS (SELECT w.g, w.round, w.n, v.x, row_number() OVER (PARTITION BY w.g, w.round ORDER BY v.x) - 1 AS i FROM w JOIN v ON v.g = w.g AND v.place = w.place),
q AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS i FROM o WHERE i = least(n - 1, CAST(floor(0.99::DOUBLE * n) AS BIGINT)))
SELECT g, max(x) FILTER (WHERE i = least(19, CAST(floor((1 - 0.9::DOUBLE) / 2 * 20) AS BIGINT))) AS low, max(x) FILTER (WHERE i = least(19, CAST(floor((1 - (1 - 0.9::DOUBLE) / 2) * 20) AS BIGINT))) AS high FROM q GROUP BY g"""

SQL = {
    "bootstrap_ci": _BOOTSTRAP,
    "pctl_floor": f"{_RANKS} SELECT g, {_at(0.5, 'p50')}, {_at(0.9, 'p90')}, {_at(0.99, 'p99')}, {_at(0.999, 'p999')}, {_at(1.0, 'max')}, max(n) AS n FROM r GROUP BY g",
    "pctl_sweep": _RANKS + " UNION ALL ".join(f" SELECT g, CAST({round(q, 9)!r} AS DOUBLE) AS q, {_at(q, 'value')} FROM r GROUP BY g" for q in _GRID),
    "mean_trunc": f"WITH {SAMPLES_SQL} SELECT g, CAST(sum(x) // count(x) AS BIGINT) AS mean, count(x) AS n FROM s GROUP BY g",
    "moments": _MOMENTS,
    "iqr": f"{_RANKS}, p AS (SELECT g, {_at(0.25, 'a')}, {_at(0.75, 'b')} FROM r GROUP BY g) SELECT g, greatest(b - a, 0) AS iqr FROM p",
    "mad": (
        f"{_RANKS}, p AS (SELECT g, {_at(0.5, 'm')} FROM r GROUP BY g), e AS (SELECT g, abs(x - m) AS x, row_number() OVER (PARTITION BY g ORDER BY abs(x - "
        f"m)) AS rk, count(*) OVER (PARTITION BY g) AS n FROM s JOIN p USING (g)) SELECT g, {_at(0.5, 'mad')} FROM e GROUP BY g"
    ),
    "tail_expectation": (
        f"{_RANKS}, p AS (SELECT g, {_at(0.95, 'cutoff')} FROM r GROUP BY g) SELECT g, cutoff, CAST(coalesce(sum(x) FILTER (WHERE x > cutoff) // nullif(count(*) "
        "FILTER (WHERE x > cutoff), 0), cutoff) AS BIGINT) AS cte FROM s JOIN p USING (g) GROUP BY g, cutoff"
    ),
    "hill": (
        f"WITH {SAMPLES_SQL}, r AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x DESC) AS rk FROM s), p AS (SELECT g, x AS edge FROM r WHERE rk "
        "= 51) SELECT g, round(sum(ln(x / CAST(edge AS DOUBLE))) / 50, 6) AS hill FROM r JOIN p USING (g) WHERE rk <= 50 GROUP BY g"
    ),
    "tail_fatness": f"{_RANKS}, p AS (SELECT g, {_at(0.5, 'a')}, {_at(0.99, 'b')} FROM r GROUP BY g) SELECT g, round(b / CAST(a AS DOUBLE), 6) AS fatness FROM p",
    "jitter": (
        f"WITH {SAMPLES_SQL}, r AS (SELECT g, x, (row_number() OVER (PARTITION BY g ORDER BY seq) - 1) // 32 AS w FROM s), m AS (SELECT g, w, avg(x) AS m FROM "
        "r GROUP BY g, w HAVING count(*) = 32) SELECT s.g, coalesce(max(j), 0.0) AS jitter FROM (SELECT DISTINCT g FROM s) s LEFT JOIN (SELECT g, round(CASE "
        "WHEN count(*) < 2 THEN 0.0 ELSE least(1.0, stddev_pop(m) / avg(m)) END, 6) AS j FROM m GROUP BY g) q ON s.g = q.g GROUP BY s.g"
    ),
    "cdf_log2": (
        f"WITH {SAMPLES_SQL}, c AS (SELECT g, greatest(length(bin(x)) - 1, 0) AS bucket, count(*) AS c FROM s GROUP BY ALL), f AS (SELECT g, CAST(b AS INT) "
        "AS bucket FROM (SELECT DISTINCT g FROM s), range(64) t(b)) SELECT g, bucket, coalesce(c, 0) AS n, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY g ORDER "
        "BY bucket) AS BIGINT) AS cumulative FROM f LEFT JOIN c USING (g, bucket)"
    ),
    "ks_distance": (
        f"WITH {SAMPLES_SQL}, v AS (SELECT x, count(*) FILTER (WHERE g = 'click') AS a, count(*) FILTER (WHERE g = 'view') AS b FROM s WHERE g IN ('click', "
        "'view') GROUP BY x), c AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS an, sum(b) OVER () AS bn FROM "
        "v) SELECT round(max(abs(CAST(ca AS DOUBLE) / an - CAST(cb AS DOUBLE) / bn)), 9) AS ks FROM c"
    ),
    "cohens_d": (
        f"WITH {SAMPLES_SQL}, m AS (SELECT count(*) FILTER (WHERE g = 'click') AS na, count(*) FILTER (WHERE g = 'view') AS nb, avg(x) FILTER (WHERE g = 'click') "
        "AS ma, avg(x) FILTER (WHERE g = 'view') AS mb, var_samp(x) FILTER (WHERE g = 'click') AS va, var_samp(x) FILTER (WHERE g = 'view') AS vb FROM s) "
        "SELECT round((mb - ma) / sqrt((va * (na - 1) + vb * (nb - 1)) / (na + nb - 2)), 6) AS d FROM m"
    ),
    "hdr_counts": f"{_H} SELECT g, bucket, c FROM h",
    "hdr_quantile": f"{_H} SELECT g, CAST(sum(c) AS BIGINT) AS n, {_hq(0.5, 'p50')}, {_hq(0.9, 'p90')}, {_hq(0.99, 'p99')}, {_hq(1.0, 'p100')} FROM k GROUP BY g",
    "hdr_rank_of_value": (
        f"{_H}, v AS (SELECT {_bucket('CAST(5000 AS BIGINT)')} AS b5) SELECT g, round(sum(CASE WHEN bucket <= b5 THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE), "
        "9) AS share, CAST(sum(CASE WHEN bucket = b5 THEN c ELSE 0 END) AS BIGINT) AS count_at FROM h, v GROUP BY g"
    ),
    "hdr_summary": f"{_H} SELECT g, CAST(min(lo) AS BIGINT) AS min, CAST(max(lo) AS BIGINT) AS max, round(sum(lo * c) / CAST(sum(c) AS DOUBLE), 6) AS mean, CAST(sum(c) AS BIGINT) AS n FROM k GROUP BY g",
    "hdr_merge": f"WITH {SAMPLES_SQL} SELECT CAST({_bucket('x')} AS BIGINT) AS bucket, count(*) AS c FROM s GROUP BY 1",
    "hdr_tagged": (
        f"WITH {SAMPLES_SQL}, t AS (SELECT g, x FROM s UNION ALL SELECT '(all)', x FROM s), h AS (SELECT g, CAST({_bucket('x')} AS BIGINT) AS bucket, count(*) "
        f"AS c FROM t GROUP BY ALL), k AS (SELECT *, {_lower('bucket')} AS lo, sum(c) OVER (PARTITION BY g ORDER BY bucket) AS cum, sum(c) OVER (PARTITION "
        f"BY g) AS total FROM h) SELECT g, CAST(sum(c) AS BIGINT) AS n, {_hq(0.5, 'p50')}, {_hq(0.99, 'p99')} FROM k GROUP BY g"
    ),
    "hdr_co_backfill": (
        f"WITH {SAMPLES_SQL}, b AS (SELECT g, x FROM s UNION ALL SELECT g, x - 1000 * t.k FROM s, range(1, 100) t(k) WHERE x - 1000 * t.k >= 1000) SELECT g, "
        f"CAST({_bucket('x')} AS BIGINT) AS bucket, count(*) AS c FROM b GROUP BY ALL"
    ),
    "hdr_linear": (
        f"{_H}, b AS (SELECT g, CAST((lo // 1000) * 1000 AS BIGINT) AS lo, CAST(sum(c) AS BIGINT) AS n FROM k GROUP BY g, lo // 1000) SELECT g, lo, lo + 1000 "
        "AS hi, n, CAST(sum(n) OVER (PARTITION BY g ORDER BY lo) AS BIGINT) AS cumulative FROM b"
    ),
    "hdr_log": (
        f"{_H}, b AS (SELECT g, CAST(CASE WHEN lo = 0 THEN 0 ELSE length(bin(lo)) END AS INT) AS band, CAST(sum(c) AS BIGINT) AS n FROM k GROUP BY ALL) SELECT "
        "g, band, CAST(CASE WHEN band = 0 THEN 0 ELSE pow(2, band - 1) END AS BIGINT) AS lo, n, CAST(sum(n) OVER (PARTITION BY g ORDER BY band) AS BIGINT) "
        "AS cumulative FROM b"
    ),
    "hdr_pct_iter": f"{_H} SELECT g, CAST(p AS INT) AS pct, CAST(min(lo) AS BIGINT) AS value FROM k, range(10, 101, 10) t(p) WHERE cum >= greatest(1, ceil(total * p / 100.0)) GROUP BY g, p",
    "hdr_decay": f"WITH {SAMPLES_SQL} SELECT g, CAST({_bucket('x')} AS BIGINT) AS bucket, round(sum(pow(0.5, (20000 - seq) / 5000.0)), 6) AS c FROM s GROUP BY ALL",
    "hdr_intervals": f"WITH {SAMPLES_SQL} SELECT g, date_trunc('day', ts) AS start, CAST({_bucket('x')} AS BIGINT) AS bucket, count(*) AS c FROM s GROUP BY ALL",
}
