"""ANSI SQL of the core queries, over whole tables."""

from __future__ import annotations

NUDGE = "CAST(1.234567e-10 AS DOUBLE)"
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def clean_label(column: str) -> str:
    bare = f"trim({column}, {BLANKS})"
    return f"""CASE WHEN length({bare}) >= 2 AND starts_with({bare}, '"') AND ends_with({bare}, '"') THEN substr({bare}, 2, length({bare}) - 2) ELSE {bare} END"""


CELLS = f"""raw AS (
  SELECT {clean_label("label")} AS label, upper(trim(kmer, {BLANKS})) AS k, count AS c, batch FROM spectra
), valid AS (
  SELECT DISTINCT label, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, c, batch FROM raw WHERE label IS NOT NULL AND k IS NOT NULL AND c > 0
), cells AS (
  SELECT label, kmer, CAST(sum(c) AS BIGINT) AS count FROM valid GROUP BY label, kmer
)"""

META = f"""tidied AS (
  SELECT {clean_label("label")} AS label, nullif(nullif(lower(trim(class_name, {BLANKS})), ''), 'na') AS class_name, nullif(nullif(lower(trim(host, {BLANKS})), ''), 'na') AS host,
    nullif(nullif(lower(trim(site, {BLANKS})), ''), 'na') AS site, replace(received, '/', '-') AS received FROM metadata
), meta AS (
  SELECT label, class_name, host, site FROM tidied WHERE label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY received DESC NULLS LAST, class_name DESC NULLS LAST, host DESC NULLS LAST, site DESC NULLS LAST) = 1
)"""

VECTORS = f"""named AS (
  SELECT {clean_label("label")} AS label, coords, run_no FROM twisted
), usable AS (
  SELECT * FROM named WHERE label IS NOT NULL AND len(coords) = 32
    AND len(list_filter(coords, lambda x: x IS NOT NULL AND isfinite(x))) = 32 AND len(list_filter(coords, lambda x: x <> 0)) > 0
), latest AS (
  SELECT label, max_by(coords, run_no) AS coords FROM usable GROUP BY label
)"""

CLASSES = f"""{VECTORS}, {META}, entries AS (
  SELECT label, unnest(coords) AS x, generate_subscripts(coords, 1) AS dim FROM latest
), means AS (
  SELECT class_name, dim, avg(x) AS x FROM entries JOIN meta USING (label) WHERE class_name IS NOT NULL GROUP BY class_name, dim
), classes AS (
  SELECT class_name AS label, list(x ORDER BY dim) AS coords FROM means GROUP BY class_name
)"""

#: powers(1,1,2)
WEIGHTS = "weights AS (SELECT list(value * value / whole ORDER BY dim) AS w FROM inertia, (SELECT sum(value * value) AS whole FROM inertia) AS s)"
FLAT = "weights AS (SELECT list(1.0 / n ORDER BY dim) AS w FROM inertia, (SELECT count(*) AS n FROM inertia) AS s)"

LINES = r"""body AS (
  SELECT line_id, file_name, line_no, string_split(CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END, chr(9)) AS f FROM spectra_lines
), fields AS (
  SELECT line_id, file_name, line_no, coalesce(len(f), 0) AS n,
    CASE WHEN length(f[1]) >= 2 AND f[1][1] = '"' AND f[1][-1] = '"' THEN f[1][2:-2] ELSE f[1] END AS name,
    CASE WHEN length(f[2]) >= 2 AND f[2][1] = '"' AND f[2][-1] = '"' THEN f[2][2:-2] ELSE f[2] END AS v FROM body
), judged AS (
  SELECT *, CASE WHEN n <> 2 THEN 'columns' WHEN contains(name, '"') OR contains(v, '"') THEN 'quoting' WHEN line_no = 1 AND name <> '' THEN 'header'
    WHEN name <> '' AND NOT regexp_full_match(name, '[ACGTacgt]{12}') THEN 'name' WHEN name = '' AND v = '' THEN 'value'
    WHEN name <> '' AND (NOT regexp_full_match(v, '[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') OR coalesce(TRY_CAST(v AS DOUBLE), 1e300) > 2147483647) THEN 'value' END AS reason FROM fields
)"""


def _stats(by: str, threshold: float, power: float) -> str:
    limit = f"{threshold} * total" if threshold < 1 else str(threshold)
    return f"""WITH {CELLS}, t AS (SELECT *, sum(power(CAST(count AS DOUBLE), {power})) OVER (PARTITION BY {by}) AS total FROM cells)
SELECT {by}, count(*) FILTER (count >= {limit}) AS non_zero, CAST(0 AS BIGINT) AS min, CAST(coalesce(max(count) FILTER (count >= {limit}), 0) AS BIGINT) AS max,
  round(coalesce(sum(power(CAST(count AS DOUBLE), {power})) FILTER (count >= {limit}), 0), 6) AS sum, round(coalesce(sum(ln(count) * {power}) FILTER (count >= {limit}), 0), 6) AS sum_log FROM t GROUP BY {by}"""


def _transform(value: str, threshold: float, power: float, digits: int = 6) -> str:
    """``value`` may use c (the count), t (the effective threshold), mx, s, sl and nz (the label's statistics)."""
    limit = f"{threshold} * total" if threshold < 1 else str(threshold)
    return f"""WITH {CELLS}, sized AS (SELECT *, sum(power(CAST(count AS DOUBLE), {power})) OVER (PARTITION BY label) AS total FROM cells
), stats AS (
  SELECT label, count(*) FILTER (count >= {limit}) AS nz, coalesce(max(count) FILTER (count >= {limit}), 0) AS mx, coalesce(sum(power(CAST(count AS DOUBLE), {power})) FILTER (count >= {limit}), 0) AS s,
    coalesce(sum(ln(count) * {power}) FILTER (count >= {limit}), 0) AS sl FROM sized GROUP BY label
), ready AS (
  SELECT label, kmer, CAST(count AS DOUBLE) AS c, mx, s, sl, nz, {f"{threshold} * s" if threshold < 1 else f"CAST({threshold} AS DOUBLE)"} AS t FROM cells JOIN stats USING (label)
) SELECT label, kmer, round({value}, {digits}) AS value FROM ready"""


def _distance(total: str, scale: str, weights: str, normalise: bool) -> str:
    norm = lambda v: f"CASE WHEN {scale.format(_fold(f'list_zip({v}, w)', total, True))} = 0 THEN 1.0 ELSE {scale.format(_fold(f'list_zip({v}, w)', total, True))} END" if normalise else "1.0"
    return f"""WITH {CLASSES}, {weights}, a AS (SELECT label, list_transform(coords, lambda x: x / n) AS coords FROM (SELECT label, coords, {norm("coords")} AS n FROM latest, weights)
), b AS (SELECT label, list_transform(coords, lambda x: x / n) AS coords FROM (SELECT label, coords, {norm("coords")} AS n FROM classes, weights)
) SELECT a.label AS row_label, b.label AS col_label, round({scale.format(_fold("list_zip(a.coords, b.coords, w)", total, False))}, 6) AS distance FROM a, b, weights"""


def _fold(zipped: str, total: str, single: bool) -> str:
    gap, weight = ("z[1]", "z[2]") if single else ("(z[1] - z[2])", "z[3]")
    return f"list_sum(list_transform({zipped}, lambda z: {total.format(gap)} * {weight}))"


SQUARE, ROOT, HALF = "({0} * {0})", "sqrt({0})", "({0} / 2)"
EUCLIDEAN = _distance(SQUARE, ROOT, WEIGHTS, True)
NORMAL = "CASE WHEN n = 0 THEN 1.0 ELSE n END"


def _nearest(keep: int) -> str:
    """Summary of the unrounded Euclidean distances from class means."""
    exact = EUCLIDEAN.replace("round(sqrt(", "(sqrt(").replace(", 6) AS distance", ") AS distance")
    with_, _, body = exact.partition(") SELECT a.label")
    return f"""{with_}), d AS (SELECT a.label{body}
), moments AS (SELECT row_label, avg(distance) AS mean, coalesce(stddev_samp(distance), 0) AS stddev, count(*) AS n FROM d GROUP BY row_label
), med AS (SELECT row_label, (list(distance ORDER BY distance))[n // 2 + 1] AS median FROM d JOIN moments USING (row_label) GROUP BY row_label, n
), off AS (SELECT row_label, (list(abs(distance - median) ORDER BY abs(distance - median)))[n // 2 + 1] AS mad FROM d JOIN med USING (row_label) JOIN moments USING (row_label) GROUP BY row_label, n
), near AS (SELECT *, rank() OVER (PARTITION BY row_label ORDER BY distance) AS tied, row_number() OVER (PARTITION BY row_label ORDER BY distance, col_label) AS rank FROM d
), summary AS (SELECT row_label AS label, mean, stddev, median, mad, CAST(rank AS INTEGER) AS rank, col_label AS neighbour, distance, (distance - mean) / nullif(stddev, 0) AS z
  FROM near JOIN moments USING (row_label) JOIN med USING (row_label) JOIN off USING (row_label) WHERE tied <= {keep})"""


SUMMARY_COLUMNS = "label, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(median, 6) AS median, round(mad, 6) AS mad, rank, neighbour, round(distance, 6) AS distance, round(z, 6) AS z"

COMBINED = """, norms AS (SELECT label, sum(count) AS norm FROM cells GROUP BY label
), grouped AS (SELECT label, {group} AS g FROM {source} WHERE {group} IS NOT NULL
), tops AS (SELECT g, max(coalesce(norm, 0)) AS top, count(*) AS found, count(*) FILTER (norm > 0) AS usable FROM grouped LEFT JOIN norms USING (label) GROUP BY g
), scaled AS (SELECT g AS label, kmer, CAST(count AS DOUBLE) * top / norm AS v, found, usable FROM cells JOIN norms USING (label) JOIN grouped USING (label) JOIN tops USING (g)
), combined AS (SELECT label, kmer, CAST(trunc(round(sum(v), 6)) AS BIGINT) AS count FROM scaled GROUP BY label, kmer HAVING trunc(round(sum(v), 6)) > 0)"""

BY_CLASS = f"WITH {CELLS}, {META}" + COMBINED.format(group="class_name", source="meta")
SELECTED = "chosen AS (SELECT DISTINCT cells.label FROM cells JOIN meta USING (label) WHERE regexp_matches(label, '^(?:LB|QS)') AND regexp_matches(coalesce(host, ''), '^(?:human|cattle)'))"

FITTED = f"""{BY_CLASS}, whole AS (SELECT CAST(sum(count) AS DOUBLE) AS n FROM combined
), masses AS (SELECT label, sum(count) / any_value(n) AS c FROM combined, whole GROUP BY label
), held AS (SELECT kmer, sum(count) / any_value(n) AS r FROM combined, whole GROUP BY kmer)"""

COMBINED_HOSTS = COMBINED.format(group="host", source="meta").replace(", norms AS", ", hnorms AS").replace("norms USING", "hnorms USING").replace("JOIN hhnorms", "JOIN hnorms")
for _old, _new in (("grouped", "hgrouped"), ("tops", "htops"), ("scaled", "hscaled"), ("combined AS", "hosts AS")):
    COMBINED_HOSTS = COMBINED_HOSTS.replace(_old, _new)

LONG = "SELECT label, unnest(coords) AS x, CAST(generate_subscripts(coords, 1) AS INTEGER) AS dim"


def _kmers(k: int, letters: bool, content: str, one: bool = False) -> str:
    seq = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')" if letters else "text"
    lint = "regexp_replace(translate({0}, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g')" if content != "protein" else "regexp_replace(translate({0}, 'acdefghiklmnpqrstvwy', 'ACDEFGHIKLMNPQRSTVWY'), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g')"
    bad = "X" if content == "protein" else "N"
    name = "least(k, reverse(translate(k, 'ACGT', 'TGCA')))" if content == "ds" else "k"
    return f"""SELECT {"'all'" if one else "lang"} AS label, {name} AS kmer, count(*) AS count FROM (
  SELECT lang, substr(s, CAST(i AS INTEGER), {k}) AS k FROM (SELECT lang, s, unnest(range(1, length(s) - {k - 2})) AS i FROM (SELECT lang, {lint.format(seq)} AS s FROM documents))
) WHERE NOT contains(k, '{bad}') GROUP BY ALL"""


def _distill() -> str:
    names = [(s, m) for s in ("Avg", "Var", "COV") for m in ("Mean", "Median")]
    buckets = ", ".join(
        f"avg({s}) FILTER ({keep}) AS {side}{s}Mean, (list({s} ORDER BY {s}) FILTER ({keep}))[count(*) FILTER ({keep}) // 2 + 1] AS {side}{s}Median" for s in ("Avg", "Var", "COV") for side, keep in (("Inner", "ga = gb"), ("Outer", "ga <> gb"))
    )
    lines = ", ".join(f"regr_slope(Outer{s}{m}, Inner{s}{m}) AS s{s}{m}, regr_intercept(Outer{s}{m}, Inner{s}{m}) AS b{s}{m}" for s, m in names)
    shown = ", ".join(f"round(Inner{s}{m}, 7) AS Inner{s}{m}, round(Outer{s}{m}, 7) AS Outer{s}{m}, round(Outer{s}{m} - coalesce(b{s}{m} + s{s}{m} * Inner{s}{m}, 0), 7) AS Residual{s}{m}" for s, m in names)
    return f"""WITH cells AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, CAST(l_partkey AS VARCHAR) AS kmer, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY ALL
), sums AS (SELECT label, sum(count) AS s FROM cells GROUP BY label
), spectra_ AS (SELECT CAST(s_suppkey AS VARCHAR) AS label, CAST(s_nationkey AS VARCHAR) AS g FROM supplier
), dense AS (SELECT label, g, kmer, coalesce(count / CAST(s AS DOUBLE), 0) AS x FROM spectra_ CROSS JOIN (SELECT DISTINCT kmer FROM cells) LEFT JOIN cells USING (label, kmer) LEFT JOIN sums USING (label)
), pairs AS (SELECT a.kmer, least(a.g, b.g) AS ga, greatest(a.g, b.g) AS gb, abs(a.x - b.x) AS d FROM dense a JOIN dense b ON a.kmer = b.kmer AND a.label < b.label
), filled AS (SELECT kmer, ga, gb, avg(d) AS Avg, CASE WHEN count(*) > 1 AND var_samp(d) * (count(*) - 1) > 1e-12 * sum(d * d) THEN var_samp(d) ELSE 0 END AS Var FROM pairs GROUP BY ALL
), classes AS (SELECT g, count(*) AS n FROM spectra_ GROUP BY g
), lone AS (SELECT kmer, g AS ga, g AS gb, 0.0 AS Avg, 0.0 AS Var FROM classes CROSS JOIN (SELECT DISTINCT kmer FROM cells) WHERE n = 1
), buckets AS (SELECT *, CASE WHEN Avg = 0 THEN 0 ELSE sqrt(Var) / Avg END AS COV FROM (SELECT * FROM filled UNION ALL SELECT * FROM lone)
), stats AS (SELECT kmer, {buckets} FROM buckets GROUP BY kmer
), lines AS (SELECT {lines} FROM stats) SELECT kmer, {shown} FROM stats, lines"""


POINTS = "points AS (SELECT CAST(vec_id AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS coords, CAST(label AS VARCHAR) AS class_name FROM embeddings)"
POINT_PAIRS = f"""{POINTS}, entries AS (SELECT label, class_name, CAST(coords AS DOUBLE[64]) AS v FROM points
), d AS (SELECT a.label AS label, b.label AS neighbour, b.class_name AS class_name, sqrt(list_sum(list_transform(list_zip(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64) AS distance FROM entries a, entries b)"""

GAPS = f"""places AS (SELECT dim, x, label, row_number() OVER (PARTITION BY dim ORDER BY x, label) AS position, lead(x) OVER (PARTITION BY dim ORDER BY x, label) AS next FROM ({LONG} FROM {{0}})
), gaps AS (SELECT dim, next - x AS gap, position, row_number() OVER (ORDER BY next - x DESC, dim, position) AS split_id FROM places WHERE next IS NOT NULL)"""


TWISTER_KMERS = f"""base AS (SELECT upper(trim(kmer, {BLANKS})) AS k, weights FROM twister WHERE kmer IS NOT NULL AND weights IS NOT NULL
), tw AS (SELECT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, max(weights) AS weights FROM base GROUP BY ALL)"""


def _projected() -> str:
    return f"""WITH {CELLS}, {TWISTER_KMERS}, j AS (SELECT label, count, unnest(weights) AS w, CAST(generate_subscripts(weights, 1) AS INTEGER) AS dim FROM cells JOIN tw USING (kmer))
SELECT label, dim, round(sum(count * w) / sum(count) + {NUDGE}, 6) AS value FROM j GROUP BY label, dim"""


def _vectors_long() -> str:
    return f"WITH {VECTORS}, l AS ({LONG} FROM latest) SELECT label, dim, round(x + {NUDGE}, 6) AS value FROM l"


def _twister_sums() -> str:
    return f"WITH {TWISTER_KMERS}, j AS (SELECT kmer, unnest(weights) AS w, generate_subscripts(weights, 1) AS dim FROM tw) SELECT kmer, round(sum(w * value) + {NUDGE}, 6) AS value FROM j JOIN inertia USING (dim) GROUP BY kmer"


def _flat_texts(segments: str) -> str:
    return rf"WITH flat AS (SELECT CAST(doc_id AS VARCHAR) AS tag, regexp_replace(text, '[ >\t\n\r\f\v]', '', 'g') AS seq FROM documents) SELECT tag, segm, CAST(length(seq) AS INTEGER) AS letters FROM flat, ({segments}) v(segm) WHERE seq <> ''"


def _host_clr() -> str:
    """Dense values of the hosts' spectra: place is the label's among them, from 0."""
    return f"WITH {CELLS}, {META}" + COMBINED.format(group="host", source="meta") + """, stats AS (SELECT label, count(*) AS nz, sum(ln(count)) AS sl FROM combined GROUP BY label
), l AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS place FROM stats
), dense AS (SELECT kmer, label, place, coalesce(count, 0) AS count, ln(greatest(CAST(coalesce(count, 0) AS DOUBLE), CAST(0.1 AS DOUBLE))) - sl / nz AS value FROM (SELECT DISTINCT kmer FROM combined) CROSS JOIN l LEFT JOIN combined USING (kmer, label))"""


def _shares() -> str:
    return f"""{BY_CLASS}, shares AS (SELECT label, kmer, count / CAST(sum(count) OVER (PARTITION BY label) AS DOUBLE) AS x FROM combined
), dense AS (SELECT a.label AS row_label, b.label AS col_label, coalesce(p.x, 0) AS x, coalesce(q.x, 0) AS y FROM (SELECT DISTINCT label FROM shares) a CROSS JOIN (SELECT DISTINCT label FROM shares) b
  CROSS JOIN (SELECT DISTINCT kmer FROM shares) k LEFT JOIN shares p ON p.label = a.label AND p.kmer = k.kmer LEFT JOIN shares q ON q.label = b.label AND q.kmer = k.kmer)"""


def oracle_sql() -> dict[str, str]:
    passed, kept = "CASE WHEN c >= t THEN {0} ELSE 0.0 END", "greatest(CASE WHEN c >= t THEN c ELSE 0.0 END, 0.1)"
    return {
        "p4_found": f"WITH {LINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
        "p4_load": f"""WITH {LINES}, headed AS (
  SELECT *, last_value(CASE WHEN n = 2 AND name = '' THEN line_no END IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM judged
) SELECT k.file_name, k.line_no, h.v AS label, upper(k.name) AS name, CAST(k.v AS DOUBLE) AS v FROM headed k
  LEFT JOIN judged h ON h.file_name = k.file_name AND h.line_no = k.head AND h.reason IS NULL WHERE k.reason IS NULL AND k.name <> ''""",
        "spectra_accumulate": f"WITH {CELLS} SELECT label, kmer, count FROM cells",
        "database_summary": f"WITH {CELLS} SELECT count(DISTINCT label) AS spectra, count(DISTINCT kmer) AS kmers, 'class_name,host,site' AS fields FROM cells",
        "kmer_count_dna_ds": _kmers(5, True, "ds"),
        "kmer_count_dna_ss": _kmers(5, True, "ss"),
        "kmer_count_protein": _kmers(3, False, "protein"),
        "kmer_count_one_spectrum": _kmers(6, True, "ds", True),
        "kmer_hash_hex": f"WITH {CELLS}, k AS (SELECT DISTINCT kmer FROM cells) SELECT kmer, format('{{:x}}', CAST(list_sum(list_transform(range(1, length(kmer) + 1), lambda i: (instr('ACGT', kmer[i]) - 1) * CAST(power(4, length(kmer) - i) AS BIGINT))) AS BIGINT)) AS code FROM k",
        "col_stats": _stats("label", 2, 1),
        "col_stats_relative": _stats("label", 0.01, 0.5),
        "row_stats": _stats("kmer", 2, 1),
        "row_stats_relative": _stats("kmer", 0.01, 0.5),
        "transform_binary": _transform(f"CAST({passed.format(1.0)} AS DOUBLE)", 3, 1),
        "transform_power": _transform(passed.format("power(c, 0.5)"), 2, 0.5),
        "transform_power_relative": _transform(passed.format("c"), 0.01, 1),
        "transform_clr": _transform(f"ln({kept}) - sl / nullif(nz, 0)", 1, 1),
        "transform_clr_zeros": f"WITH {CELLS} SELECT label, round(ln(CAST(0.1 AS DOUBLE)) - sum(ln(count)) / count(*), 6) AS value FROM cells GROUP BY label",
        "transform_pseudo_zero": _transform("greatest(0.0, floor(mx * ln((c + 1) / t)) / nullif(s, 0))", 1, 0, 9),
        "transform_pseudo_half": _transform("greatest(0.0, floor((power(c, 0.5) - power(greatest(t - 1, 0), 0.5)) * power(CAST(mx AS DOUBLE), 0.5) / 0.5) / nullif(s, 0))", 2, 0.5, 9),
        "transform_pseudo_two": _transform("greatest(0.0, floor((power(c, 2) - power(t - 1, 2)) / (power(t, 2) - power(t - 1, 2))) / nullif(s, 0))", 3, 2, 9),
        "select_labels": f"WITH {CELLS}, {META} SELECT label FROM (SELECT label FROM cells UNION SELECT label FROM meta) WHERE label IN ('POOL-ENV-01', 'no such label')",
        "select_matching": f"WITH {CELLS}, {META}, {SELECTED} SELECT label FROM chosen",
        "select_negated": f"WITH {CELLS}, {META}, {SELECTED} SELECT DISTINCT label FROM cells WHERE label NOT IN (SELECT label FROM chosen)",
        "remove_selected": f"WITH {CELLS}, {META}, {SELECTED} SELECT label, count(*) AS kmers FROM cells WHERE label NOT IN (SELECT label FROM chosen) GROUP BY label",
        "nonzero_kmers": f"WITH {CELLS} SELECT kmer FROM cells GROUP BY kmer HAVING max(count) >= 50",
        "table_pivot": f"WITH {CELLS}, {META}" + COMBINED.format(group="host", source="meta") + "SELECT kmer, " + ", ".join(f"CAST(coalesce(sum(count) FILTER (label = '{h}'), 0) AS BIGINT) AS {h}" for h in ("badger", "cattle", "human", "water")) + " FROM combined GROUP BY kmer",
        "combine_mean_by_class": f"{BY_CLASS} SELECT label, kmer, count FROM combined",
        "combine_median_by_class": f"""{BY_CLASS}, upper_ AS (SELECT label, kmer, found, usable, list(v ORDER BY v DESC) AS vs FROM scaled GROUP BY label, kmer, found, usable
), medians AS (SELECT label, kmer, coalesce(vs[usable - usable // 2], 0) * found AS v FROM upper_)
SELECT label, kmer, CAST(trunc(round(v, 6)) AS BIGINT) AS count FROM medians WHERE trunc(round(v, 6)) > 0""",
        "combine_selected": f"WITH {CELLS}, {META}, {SELECTED}, named AS (SELECT label, 'combined' AS into_ FROM chosen)" + COMBINED.format(group="into_", source="named") + " SELECT label, kmer, count FROM combined",
        "combine_metadata": f"WITH {META} SELECT class_name AS label, " + ", ".join(f"CASE WHEN min(coalesce({f}, '')) = max(coalesce({f}, '')) THEN min(coalesce({f}, '')) ELSE '' END AS {f}" for f in ("host", "site")) + " FROM meta WHERE class_name IS NOT NULL GROUP BY class_name",
        "class_indicator": f"WITH {META}, f AS (SELECT class_name, min(label) AS first FROM meta WHERE class_name IS NOT NULL GROUP BY class_name), n AS (SELECT class_name, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS indicator FROM f) SELECT label, indicator FROM meta JOIN n USING (class_name)",
        "distill": _distill(),
        "ca_gram": f"{FITTED}, s AS (SELECT kmer, label, count / n / sqrt(r * c) AS s FROM combined JOIN masses USING (label) JOIN held USING (kmer), whole) SELECT a.label AS l1, b.label AS l2, round(sum(a.s * b.s), 6) AS g FROM s a JOIN s b ON a.kmer = b.kmer AND a.label <= b.label GROUP BY a.label, b.label",
        "ca_masses": f"{FITTED} SELECT label, round(c, 9) AS mass FROM masses",
        "ca_distances": f"""{FITTED}, pairs AS (SELECT a.label AS row_label, b.label AS col_label, kmer, r FROM masses a JOIN masses b ON a.label <= b.label CROSS JOIN held
) SELECT row_label, col_label, round(sqrt(sum(power(coalesce(x.count / n / a.c, 0) - coalesce(y.count / n / b.c, 0), 2) / r)), 6) AS distance FROM pairs
  JOIN masses a ON a.label = row_label JOIN masses b ON b.label = col_label CROSS JOIN whole LEFT JOIN combined x ON x.label = row_label AND x.kmer = pairs.kmer LEFT JOIN combined y ON y.label = col_label AND y.kmer = pairs.kmer GROUP BY row_label, col_label""",
        "ca_projection": f"""{FITTED}{COMBINED_HOSTS}, known AS (SELECT h.label, h.kmer, h.count / sum(h.count) OVER (PARTITION BY h.label) AS p FROM hosts h JOIN held USING (kmer)
), seen AS (SELECT k.label, f.label AS class, sum(p * (f.count / n) / r) AS u FROM known k JOIN combined f USING (kmer) JOIN held USING (kmer), whole GROUP BY k.label, f.label
), pairs AS (SELECT a.label AS row_label, b.label AS col_label, m.label AS class, c FROM (SELECT DISTINCT label FROM known) a JOIN (SELECT DISTINCT label FROM known) b ON a.label <= b.label CROSS JOIN masses m)
SELECT row_label, col_label, round(sqrt(sum(power(coalesce(x.u, 0) - coalesce(y.u, 0), 2) / c)), 6) AS distance FROM pairs
  LEFT JOIN seen x ON x.label = row_label AND x.class = pairs.class LEFT JOIN seen y ON y.label = col_label AND y.class = pairs.class GROUP BY row_label, col_label""",
        "ca_kmers": f"""{FITTED}, profile AS (SELECT kmer, m.label, c, coalesce(f.count, 0) / n / r AS p FROM held CROSS JOIN masses m CROSS JOIN whole LEFT JOIN combined f USING (kmer, label))
SELECT kmer, round(sum(power(p - c, 2) / c), 6) AS chi2 FROM profile GROUP BY kmer""",
        "kmers_threshold": f"{BY_CLASS}, k AS (SELECT kmer, sum(count) AS s, count(*) AS spectra FROM combined GROUP BY kmer) SELECT kmer, spectra FROM k WHERE s >= 0.1 * (SELECT max(s) FROM k)",
        "kmers_normalised": f"{BY_CLASS} SELECT label, kmer, round(count / CAST(sum(count) OVER (PARTITION BY label) AS DOUBLE), 9) AS value FROM combined",
        "project_spectra": f"""WITH {CELLS}, base AS (SELECT upper(trim(kmer, {BLANKS})) AS k, weights FROM twister WHERE kmer IS NOT NULL AND weights IS NOT NULL
), tw AS (SELECT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, max(weights) AS weights FROM base GROUP BY ALL
), j AS (SELECT label, count, unnest(weights) AS w, CAST(generate_subscripts(weights, 1) AS INTEGER) AS dim FROM cells JOIN tw USING (kmer))
SELECT label, dim, round(sum(count * w) / sum(count) + {NUDGE}, 6) AS value FROM j GROUP BY label, dim""",
        "metric_flat": "SELECT dim, name, round(CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM inertia), 9) AS weight FROM inertia",
        "metric_powers": "WITH r AS (SELECT dim, name, value, coalesce(sum(value) OVER (ORDER BY value DESC, dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT sum(value) FROM inertia) AS whole FROM inertia), k AS (SELECT dim, name, CASE WHEN before < 0.8 * whole THEN value * value ELSE 0 END AS v FROM r) SELECT dim, name, round(v / sum(v) OVER (), 9) AS weight FROM k",
        "vector_norms": f"WITH {VECTORS}, {WEIGHTS}, n AS (SELECT label, {ROOT.format(_fold('list_zip(coords, w)', SQUARE, True))} AS n FROM latest, weights) SELECT label, round({NORMAL}, 6) AS norm FROM n",
        "embeddings_scaled": f"WITH {VECTORS}, {FLAT}, e AS (SELECT label, list_transform(list_zip(coords, w), lambda z: z[1] * power(z[2], 1.0 / 3)) AS coords FROM latest, weights), l AS ({LONG} FROM e) SELECT label, dim, round(x, 6) AS value FROM l",
        "embeddings_normalised": f"WITH {VECTORS}, {WEIGHTS}, e AS (SELECT label, w, list_transform(list_zip(coords, w), lambda z: z[1] * sqrt(z[2])) AS coords FROM latest, weights), n AS (SELECT label, coords, {ROOT.format(_fold('list_zip(coords, w)', SQUARE, True))} AS n FROM e), l AS ({LONG}, {NORMAL} AS n FROM n) SELECT label, dim, round(x / n, 6) AS value FROM l",
        "dist_euclidean": EUCLIDEAN,
        "dist_cosine": _distance(SQUARE, HALF, WEIGHTS, True),
        "dist_minkowski": _distance("power(abs({0}), 3)", "power({0}, CAST(1 AS DOUBLE) / 3)", FLAT, False),
        "dist_self_triangular": EUCLIDEAN.replace("AS n FROM latest, weights", "AS n FROM classes, weights") + " WHERE a.label <= b.label",
        "spectral_distances": f"""{BY_CLASS}, shares AS (SELECT label, kmer, count / CAST(sum(count) OVER (PARTITION BY label) AS DOUBLE) AS x FROM combined
), unit AS (SELECT label, kmer, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM shares
), own AS (SELECT label, sum(x * x) AS t FROM unit GROUP BY label
), dot AS (SELECT a.label AS row_label, b.label AS col_label, sum(a.x * b.x) AS s FROM unit a JOIN unit b USING (kmer) GROUP BY a.label, b.label)
SELECT a.label AS row_label, b.label AS col_label, round(CASE WHEN a.label = b.label THEN 0 ELSE sqrt(greatest(0, a.t + b.t - 2 * coalesce(s, 0))) END, 6) AS distance FROM own a CROSS JOIN own b LEFT JOIN dot ON row_label = a.label AND col_label = b.label""",
        "summary_nearest": f"{_nearest(2)} SELECT {SUMMARY_COLUMNS} FROM summary",
        "summary_of_distances": f"{_nearest(3)} SELECT {SUMMARY_COLUMNS} FROM summary",
        "nearest_class": f"{_nearest(2)} SELECT label, neighbour AS predicted, round(distance, 6) AS distance FROM summary WHERE rank = 1",
        "classification_accuracy": f"{_nearest(2)} SELECT count(*) AS items, count(*) FILTER (neighbour <> class_name) AS wrong, count(*) FILTER (neighbour <> class_name AND (starts_with(neighbour, class_name || '.') OR starts_with(class_name, neighbour || '.'))) AS nearly FROM summary JOIN meta USING (label) WHERE rank = 1",
        "knn_vote": f"""WITH {POINT_PAIRS}, near AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, neighbour) AS rank FROM d WHERE label <> neighbour
), votes AS (SELECT label, class_name, count(*) AS votes, min(rank) AS first FROM near WHERE rank <= 5 GROUP BY label, class_name)
SELECT label, class_name AS predicted, round(votes / CAST(sum(votes) OVER (PARTITION BY label) AS DOUBLE), 6) AS share FROM votes QUALIFY row_number() OVER (PARTITION BY label ORDER BY votes DESC, first) = 1""",
        "related_300": f"WITH {POINT_PAIRS}, near AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY distance) AS tied, row_number() OVER (PARTITION BY label ORDER BY distance, neighbour) AS rank FROM d) SELECT label, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance FROM near WHERE tied <= 300",
        "gaps_splits": f"WITH {VECTORS}, {GAPS.format('latest')} SELECT CAST(split_id AS INTEGER) AS split_id, dim, round(gap, 6) AS gap, position FROM gaps WHERE split_id <= 10000",
        "gaps_member_ranges": f"WITH {VECTORS}, {GAPS.format('latest')}, ends AS (SELECT dim, max(position) AS last FROM gaps WHERE split_id <= 10000 GROUP BY dim) SELECT dim, position, label FROM places JOIN ends USING (dim) WHERE position <= last",
        "band_join_pairs": "SELECT a.p_partkey AS lo, b.p_partkey AS hi, round(abs(a.p_retailprice - b.p_retailprice), 6) AS distance FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND b.p_retailprice BETWEEN a.p_retailprice - 0.06 AND a.p_retailprice + 0.06 WHERE abs(a.p_retailprice - b.p_retailprice) <= CAST(0.05 AS DOUBLE)",
        "coordinate_range": "SELECT min(p_retailprice) AS low, max(p_retailprice) AS high FROM part",
        "matrix_transpose": f"WITH {CLASSES}, l AS ({LONG} FROM classes) SELECT 'Dim' || dim AS row, label AS col, round(x + {NUDGE}, 6) AS value FROM l",
        "matrix_merge_rows": f"WITH {CLASSES}, l AS ({LONG} FROM (SELECT label, coords FROM latest UNION ALL SELECT label, coords FROM classes)) SELECT label, dim, round(x + {NUDGE}, 6) AS value FROM l",
        "matrix_vector": f"WITH {VECTORS}, l AS ({LONG} FROM latest) SELECT label AS row, round(sum(x * value), 6) AS value FROM l JOIN inertia USING (dim) GROUP BY label",
        "matrix_product": f"WITH {CLASSES}, l AS ({LONG} FROM classes) SELECT a.label AS row, b.label AS col, round(sum(a.x * b.x), 6) AS value FROM l a JOIN l b USING (dim) GROUP BY a.label, b.label",
        "label_difference": f"WITH {CELLS}, {META} SELECT label FROM cells EXCEPT SELECT label FROM meta",
        "label_union": f"WITH {CELLS}, {META} SELECT label FROM cells UNION SELECT label FROM meta",
        "file_spectra_text": f"WITH {CELLS} SELECT label, kmer, count FROM cells",
        "file_spectra_hex": f"SELECT label, format('{{:x}}', CAST(list_sum(list_transform(range(1, 6), lambda i: (instr('ACGT', kmer[i]) - 1) * CAST(power(4, 5 - i) AS BIGINT))) AS BIGINT)) AS kmer, count FROM ({_kmers(5, True, 'ds')}) WHERE label IS NOT NULL",
        "file_metadata": f"WITH {META} SELECT label, coalesce(class_name, '') AS class_name, coalesce(host, '') AS host, coalesce(site, '') AS site FROM meta",
        "file_database": f"WITH {CELLS}, {META} SELECT label, kmer, count, class_name FROM cells LEFT JOIN meta USING (label)",
        "file_matrix_text": _vectors_long(),
        "file_matrix_archive": _vectors_long(),
        "file_twister_text": _twister_sums(),
        "file_twister_archive": _twister_sums(),
        "file_keep_list": f"SELECT DISTINCT trim(kmer, {BLANKS}) AS kmer FROM twister WHERE kmer IS NOT NULL AND trim(kmer, {BLANKS}) <> ''",
        "file_fasta": _flat_texts("VALUES (0)"),
        "file_fastq_paired": _flat_texts("VALUES (0), (1)"),
        "file_distances": "SELECT * FROM (" + EUCLIDEAN.replace("AS n FROM latest, weights", "AS n FROM classes, weights") + " WHERE a.label < b.label) WHERE distance > 0",
        "file_metrics": "SELECT 'metrics' AS label, dim, round(CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM inertia), 9) AS weight FROM inertia",
        "file_distill": f"SELECT kmer, InnerAvgMean, OuterAvgMean FROM ({_distill()})",
        "file_summary": f"{_nearest(2)} SELECT label, round(mean, 6) AS mean, neighbour AS nearest FROM summary WHERE rank = 1",
        "file_splits": f"WITH {CLASSES}, {GAPS.format('classes')} SELECT CAST(split_id AS INTEGER) AS split_id, round(gap + CAST(1e-7 AS DOUBLE), 5) AS weight, CAST(position AS INTEGER) AS members FROM gaps WHERE split_id <= 100",
        "table_clr": f"{_host_clr()} SELECT kmer AS name, CAST(place + 1 AS INTEGER) AS \"at\", round(value, 6) AS value FROM dense",
        "table_clr_transposed": f"{_host_clr()}, k AS (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS col FROM (SELECT DISTINCT kmer FROM combined)) SELECT label AS name, CAST(col AS INTEGER) AS \"at\", round(value, 6) AS value FROM dense JOIN k USING (kmer)",
        "table_power": f"{_host_clr()} SELECT kmer AS name, CAST(place AS INTEGER) AS \"at\", round(CASE WHEN count >= 2 THEN CAST(count AS DOUBLE) ELSE 0.0 END, 6) AS value FROM dense",
        "table_heads": "SELECT * FROM (VALUES (0, chr(9) || 'badger' || chr(9) || 'cattle' || chr(9) || 'human' || chr(9) || 'water'), (1, 'name' || chr(9) || 'BADGER' || chr(9) || 'CATTLE' || chr(9) || 'HUMAN' || chr(9) || 'WATER')) v(part, line)",
        "table_heads_transposed": "SELECT name, upper(name) AS field FROM (VALUES ('badger'), ('cattle'), ('human'), ('water')) v(name)",
        "database_listing": f"WITH {CELLS}, {META} SELECT 'spectrum' AS kind, label AS name FROM (SELECT label FROM cells UNION SELECT label FROM meta) UNION ALL SELECT DISTINCT 'kmer', kmer FROM cells UNION ALL SELECT 'field', f FROM (VALUES ('class_name'), ('host'), ('site')) v(f)",
        "database_empty": "SELECT CAST(0 AS BIGINT) AS spectra, CAST(0 AS BIGINT) AS kmers, '' AS fields",
        "selection_print": f"WITH {CELLS}, {META} SELECT label FROM (SELECT label FROM cells UNION SELECT label FROM meta) WHERE starts_with(label, 'LB')",
        "selection_filter": f"WITH {CELLS}, {META} SELECT label, count(*) AS kmers FROM cells WHERE label NOT IN (SELECT label FROM meta WHERE starts_with(coalesce(host, ''), 'human')) GROUP BY label",
        "combine_large": f"WITH {CELLS.replace('CAST(sum(c) AS BIGINT) AS count', 'CAST(sum(c) AS BIGINT) * 1000000 AS count')}, {META}, all_ AS (SELECT label, 'all' AS into_ FROM meta)" + COMBINED.format(group="into_", source="all_") + " SELECT label, kmer, count FROM combined",
        "project_vectors": _projected(),
        "kmers_kept": f"{BY_CLASS}, {TWISTER_KMERS} SELECT label, count(*) AS kmers FROM combined SEMI JOIN tw USING (kmer) GROUP BY label",
        "kmers_sampled": f"{BY_CLASS} SELECT CAST(floor(count(DISTINCT kmer) * (1.0 / 3)) AS BIGINT) AS kmers, 0 AS unknown FROM combined",
        "dist_self_symmetric": EUCLIDEAN.replace("AS n FROM latest, weights", "AS n FROM classes, weights"),
        "dist_infinity": f"WITH {CLASSES} SELECT a.label AS row_label, b.label AS col_label FROM classes a, classes b WHERE a.label < 'm'",
        "spectral_distances_cosine": f"{_shares()} SELECT row_label, col_label, round(sum((x - y) * (x - y)) / 2, 6) AS distance FROM dense GROUP BY row_label, col_label",
        "spectral_distances_minkowski": f"{_shares()} SELECT row_label, col_label, round(sum(abs(x - y)), 6) AS distance FROM dense GROUP BY row_label, col_label",
        "matrix_sparse_vector": f"WITH {VECTORS}, l AS ({LONG} FROM latest) SELECT label AS row, round(sum(x * value), 6) AS value FROM l JOIN inertia USING (dim) WHERE dim <= 3 GROUP BY label",
        "option_texts": "SELECT * FROM (VALUES ('euclidean', 'euclidean'), ('cosine', 'cosine'), ('minkowski(3)', 'minkowski(3)'), ('minkowski(2.50)', 'minkowski(2.5)'), ('flat', 'flat'), ('powers(1,1,2)', 'powers(1,1,2)'), ('powers(0.50,0.8,2.0)', 'powers(0.5,0.8,2)'), ('pow', 'power(1,1)'), ('CLR(1,1)', 'clr(1,1)'), ('pseudo(2,0.50)', 'pseudocounts(2,0.5)'), ('binary(3,1)', 'binary(3,1)')) v(text, parsed)",
        "centroid_counts": f"WITH {VECTORS} SELECT 2 * count(*) - 1 AS splits, CAST(0 AS BIGINT) AS empty, count(*) AS leaves FROM latest",
        "best_k": "WITH c AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM ({_kmers(k, True, 'ds')})" for k in (3, 4, 5)) + "), r AS (SELECT k, label, max(count) / exp(avg(ln(count))) AS ratio FROM c GROUP BY k, label), s AS (SELECT k, min(ratio) AS score FROM r GROUP BY k) SELECT k FROM s ORDER BY score DESC, k LIMIT 1",
        "train_test_split": f"WITH {META} SELECT label, class_name, CASE WHEN row_number() OVER (PARTITION BY class_name ORDER BY label) % 2 = 1 THEN 'train' ELSE 'test' END AS part FROM meta WHERE class_name IS NOT NULL",
        "dedup_first": "SELECT doc_id, file_path FROM documents QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY crawled_at NULLS FIRST, doc_id) = 1",
        "count_by_class": f"WITH {META} SELECT class_name, count(DISTINCT label) AS labels FROM meta GROUP BY class_name",
        "compare_stored_sums": f"""WITH {CELLS}, named AS (SELECT {clean_label("label")} AS label, batch, sum FROM load_stats
), stored AS (SELECT label, CAST(max_by(sum, batch) AS BIGINT) AS sum FROM named WHERE label IS NOT NULL AND sum IS NOT NULL GROUP BY label
), computed AS (SELECT label, CAST(sum(count) AS BIGINT) AS sum FROM cells GROUP BY label)
SELECT label, s.sum AS one, c.sum AS two FROM stored s FULL OUTER JOIN computed c USING (label) WHERE s.sum IS DISTINCT FROM c.sum""",
        "name_join": f"SELECT doc_id, lower(trim(d.source, {BLANKS})) AS name, max_repeats FROM documents d JOIN mix_targets m ON lower(trim(d.source, {BLANKS})) = m.source",
        "choose_k": "WITH c AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM ({_kmers(k, True, 'ds')})" for k in (3, 4, 5)) + "), r AS (SELECT k, label, max(count) / exp(avg(ln(count))) AS ratio FROM c GROUP BY k, label) SELECT k, round(min(ratio), 6) AS score FROM r GROUP BY k",
        "filter_reads": """WITH targets AS (SELECT DISTINCT substr(text, CAST(i AS INTEGER), 25) AS segment FROM (SELECT text, unnest(range(1, length(text) - 23)) AS i FROM eval_items)
), cut AS (SELECT doc_id, substr(text, CAST(i AS INTEGER), 25) AS segment FROM (SELECT doc_id, text, unnest(range(1, length(text) - 23, 25)) AS i FROM documents))
SELECT doc_id AS tag, count(*) AS hits FROM cut SEMI JOIN targets USING (segment) GROUP BY doc_id HAVING count(*) >= 3""",
    }
