"""The registered queries in plain SQL over the same tables, for checking results."""

from __future__ import annotations

from plinth.catalog.views import DIRTY_SQL, KEYED_SQL, LISTING_KEYS

_PLAIN = {"lineitem": "lineitem", "supplier": "supplier", "nation": "nation"}
DIRTY = DIRTY_SQL.format(**_PLAIN)
KEYED = KEYED_SQL.format(**_PLAIN)
KEYS = ", ".join(LISTING_KEYS)
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Fixed values, written out here so that a wrong one in the library shows.
AREA_UNITS = [
    (("sq. meter", "sq.meter"), 10.7639),
    (("sq. yard", "sq.yard"), 9.0),
    (("acre",), 43560.0),
    (("guntha",), 1089.0),
    (("perch",), 272.25),
]
FEATURE_LABELS = {
    "total_sqft": "Property size",
    "total_rooms": "Total rooms",
    "sqft_per_bhk": "Area per BHK",
    "bath_per_bhk": "Bathrooms per BHK",
    "sqft_per_room": "Area per room",
    "bhk_bath_diff": "BHK/bathroom difference",
    "bhk": "BHK",
    "bath": "Bathrooms",
    "balcony": "Balconies",
}
_NAMES = ["num__total_sqft", "num__bath", "cat__area_type_Plot Area"]
_WEIGHTS = [0.01, -0.5, 2.0]
_MEANS = [25.0, 0.05, 0.5]

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def r(expression: str, digits: int = 4) -> str:
    """Rounded like ``neat`` in the queries."""
    return f"round(CAST({expression} AS DOUBLE) + CAST({10.0 ** -(digits + 3)!r} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"


def title(x: str) -> str:
    runs = f"regexp_extract_all({x}, '(\\p{{L}}+|\\P{{L}}+)')"
    return f"array_to_string(list_transform({runs}, lambda t: upper(t[1]) || lower(t[2:])), '')"


def normal(x: str) -> str:
    return title(f"regexp_replace(trim({x}), '\\s+', ' ', 'g')")


def size_count(x: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, '([0-9]+)', 1), '') AS INTEGER)"


def area(x: str) -> str:
    t = f"trim({x})"
    first = f"TRY_CAST(NULLIF(regexp_extract({t}, '([0-9.]+)', 1), '') AS DOUBLE)"
    side = [f"trim(string_split({t}, '-')[{i}])" for i in (1, 2)]
    both = " AND ".join(f"regexp_matches({s}, '{_DECIMAL}')" for s in side)
    units = "\n".join(
        f"WHEN {' OR '.join(f'contains(lower({t}), {chr(39)}{s}{chr(39)})' for s in spellings)} "
        f"THEN {first} * CAST({factor} AS DOUBLE)"
        for spellings, factor in AREA_UNITS
    )
    return f"""CASE WHEN regexp_matches({t}, '{_DECIMAL}') THEN CAST({t} AS DOUBLE)
      WHEN len(string_split({t}, '-')) = 2 AND {both}
        THEN (TRY_CAST({side[0]} AS DOUBLE) + TRY_CAST({side[1]} AS DOUBLE)) / 2
      {units}
      ELSE {first} END"""


def status(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR lower(trim({x})) = 'ready to move' "
        "THEN 'Ready To Move' ELSE 'Under Construction' END"
    )


def place(x: str) -> str:
    return normal(f"coalesce({x}, 'Other')")


def parsed(source: str, extra: str = "") -> str:
    """Typed and normalised columns of a raw listing source."""
    return f"""SELECT {extra} {place('location')} AS location, {area('total_sqft')} AS total_sqft, bath, balcony,
      {size_count('size')} AS bhk, trim(coalesce(area_type, 'Super built-up Area')) AS area_type,
      {status('availability')} AS availability_status, price FROM ({source}) raw"""


PARSED = parsed(KEYED, KEYS + ",")


def judged(distinct: bool = True, min_count: int = 10) -> str:
    """CTE chain ending in ``judged``: parsed, folded, imputed rows with their verdict."""
    return f"""
    dirty AS ({DIRTY}),
    kept AS (SELECT {'DISTINCT' if distinct else ''} * FROM dirty),
    parsed AS ({parsed('SELECT * FROM kept')}),
    frequent AS (SELECT location AS name FROM parsed GROUP BY 1 HAVING count(*) >= {min_count}),
    essential AS (SELECT *, bhk IS NOT NULL AND total_sqft IS NOT NULL AND price IS NOT NULL AS ok FROM parsed),
    med AS (SELECT bhk AS g, median(bath) AS mb, median(balcony) AS ml FROM essential WHERE ok GROUP BY 1),
    filled AS (
      SELECT CASE WHEN location IN (SELECT name FROM frequent) THEN location ELSE 'Other' END AS location, total_sqft,
        CAST(trunc(coalesce(bath, mb, bhk)) AS INTEGER) AS bath, CAST(trunc(coalesce(balcony, ml, 1)) AS INTEGER) AS balcony,
        bhk, area_type, availability_status, price, ok
      FROM essential LEFT JOIN med ON bhk = g),
    judged AS (
      SELECT *, CASE WHEN NOT ok THEN 'null_essential'
        WHEN coalesce((CASE WHEN bhk = 0 THEN total_sqft > 0 ELSE total_sqft / bhk >= 200 END) AND total_sqft <= 25000
          AND bath <= bhk + 2 AND price > 0 AND bhk <= 12, FALSE) THEN 'kept' ELSE 'anomaly' END AS verdict
      FROM filled)"""


def clean_report(distinct: bool, min_count: int) -> str:
    kept = "count(*) FILTER (verdict = 'kept')"
    total = "(SELECT count(*) FROM dirty)"
    return f"""WITH {judged(distinct, min_count)}
    SELECT {total} AS initial_rows, {total} - count(*) AS duplicates_removed,
      count(*) FILTER (verdict = 'null_essential') AS dropped_null_essentials,
      count(*) FILTER (verdict = 'anomaly') AS domain_anomalies_filtered, {kept} AS final_cleaned_rows,
      {"'location,total_sqft,bath,balcony,bhk,area_type,availability_status,price' AS final_columns," if distinct else ""}
      {r(f"{kept} * 100.0 / {total}")} AS data_retention_rate_pct
    FROM judged"""


def gaps(source: str, columns: list[str]) -> str:
    """``column_name, missing_count, row_count`` of a source."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, count(*) AS row_count FROM ({source}) g"
        for c in columns
    )


LISTING_TYPES = {
    "area_type": "string", "availability": "string", "location": "string", "size": "string", "society": "string",
    "total_sqft": "string", "bath": "double", "balcony": "double", "price": "double",
}


def copies(source: str, columns: str) -> str:
    return (
        f"SELECT CAST(sum(c) AS BIGINT) AS total, CAST(sum(c - 1) AS BIGINT) AS extra "
        f"FROM (SELECT count(*) AS c FROM ({source}) s GROUP BY {columns}) x"
    )


def fences(source: str, columns: list[str], digits: int = 4) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS column_name, n, q1, q3, lo, hi,
          (SELECT count(*) FROM ({source}) v WHERE {c} < lo OR {c} > hi) AS outlier_count
          FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
            SELECT count({c}) AS n, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1,
              CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3 FROM ({source}) u) a) b""")
    return f"""SELECT column_name, n, {r('q1', digits)} AS q1, {r('q3', digits)} AS q3, {r('q3 - q1', digits)} AS iqr,
      {r('lo', digits)} AS lower_bound, {r('hi', digits)} AS upper_bound, outlier_count,
      {r('outlier_count * 100.0 / n', digits)} AS outlier_pct FROM ({' UNION ALL '.join(parts)}) f"""


def target_stats(source: str, c: str, digits: int) -> str:
    values = {
        "mean": f"avg({c})", "median": f"median({c})", "std": f"stddev_samp({c})", "min": f"min({c})",
        "q25": f"quantile_cont({c}, 0.25)", "q75": f"quantile_cont({c}, 0.75)", "max": f"max({c})",
        "iqr": f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "skewness": f"skewness({c})",
        "kurtosis": f"kurtosis({c})", "log_skewness": f"skewness(ln(1 + {c})) FILTER ({c} > 0)",
    }
    return f"SELECT '{c}' AS target_name, count({c}) AS count, " + ", ".join(
        f'{r(v, digits)} AS "{k}"' for k, v in values.items()
    ) + f" FROM {source}"


def numeric_summary(source: str, columns: list[str], digits: int = 4) -> str:
    values = {
        "mean": "avg({c})", "median": "median({c})", "std": "stddev_samp({c})", "min": "min({c})",
        "q25": "quantile_cont({c}, 0.25)", "q75": "quantile_cont({c}, 0.75)", "max": "max({c})",
        "skewness": "skewness({c})",
    }
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, "
        + ", ".join(f'{r(v.format(c=c), digits)} AS "{k}"' for k, v in values.items()) + f" FROM {source}"
        for c in columns
    )


def correlation(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + ("1.0::DOUBLE" if a == b else r(f"corr({a}, {b})"))
        + f" AS corr FROM ({source}) s" + (" LIMIT 1" if False else (" HAVING count(*) > 0" if a == b else ""))
        for a in columns for b in columns
    )


SALES = """SELECT l_partkey, p_brand, p_type, n_name, l_extendedprice AS price, l_quantity AS total_sqft,
  l_extendedprice * 100000 / nullif(l_quantity, 0) AS price_per_sqft
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey"""


def group_stats(by: str, least: int, order: str = "", digits: int = 2) -> str:
    limit = f"ORDER BY median(price_per_sqft) {order}, {by} LIMIT 15" if order else ""
    return f"""SELECT {by}, count(price) AS listing_count, {r('median(price)', digits)} AS median_price,
      {r('avg(price)', digits)} AS mean_price, {r('median(price_per_sqft)', digits)} AS median_price_per_sqft,
      {r('avg(price_per_sqft)', digits)} AS mean_price_per_sqft
      FROM ({SALES}) s GROUP BY {by} HAVING count(price) >= {least} {limit}"""


def histogram(values: str, bins: int, digits: int = 4) -> str:
    return f"""WITH data AS ({values}), edge AS (SELECT min(value) AS lo, max(value) AS hi FROM data),
    hits AS (SELECT least(CAST(floor((value - lo) * {bins} / (hi - lo)) AS BIGINT), {bins - 1}) AS bin, count(*) AS n
      FROM data, edge GROUP BY 1)
    SELECT i AS bin, {r(f'lo + i * ((hi - lo) / {bins})', digits)} AS bin_start,
      {r(f'lo + (i + 1) * ((hi - lo) / {bins})', digits)} AS bin_end, coalesce(n, 0) AS frequency
    FROM range({bins}) AS b(i) CROSS JOIN edge LEFT JOIN hits ON hits.bin = i"""


def box_stats(source: str, by: str, c: str, digits: int) -> str:
    return f"""WITH box AS (
      SELECT {by} AS g, count({c}) AS n, avg({c}) AS mean, quantile_cont({c}, 0.25) AS q1, median({c}) AS med,
        quantile_cont({c}, 0.75) AS q3 FROM {source} GROUP BY 1),
    ends AS (
      SELECT g, min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS lo,
        max({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS hi,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
      FROM {source} JOIN box ON {by} = g GROUP BY 1)
    SELECT g AS {by}, n AS count, {r('mean', digits)} AS mean, {r('q1', digits)} AS q1, {r('med', digits)} AS median,
      {r('q3', digits)} AS q3, {r('least(q1, lo)', digits)} AS whisker_low,
      {r('greatest(q3, hi)', digits)} AS whisker_high, outliers FROM box JOIN ends USING (g)"""


def split_order(source: str, keys: list[str], seed: int) -> str:
    """Rows with their 1-based position in split order and the total."""
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"""SELECT *, row_number() OVER (ORDER BY h, {', '.join(keys)}) AS place, count(*) OVER () AS total
      FROM (SELECT *, CAST('0x' || substr(md5('{seed}|' || {text}), 1, 8) AS BIGINT) AS h FROM {source}) hashed"""


def metrics(by: str = "") -> str:
    e, y = "abs(y - p)", "abs(y)"
    values = {
        "MAE_lakhs": f"avg({e})", "RMSE_lakhs": f"sqrt(avg({e} * {e}))",
        "R2": f"1 - sum({e} * {e}) / (var_pop(y) * count(y))", "MedianAE_lakhs": f"median({e})",
        "MAPE_percent": f"avg(CASE WHEN {y} > 1e-9 THEN {e} / {y} END) * 100",
        **{f"Within_{s}pct_percent": f"avg(CASE WHEN {e} <= {s / 100} * {y} THEN 1.0 ELSE 0.0 END) * 100" for s in (10, 20, 30)},
        "Mean_Error_lakhs": "avg(p - y)",
    }
    listed = ", ".join(f"{r(v, 3)} AS {k}" for k, v in values.items())
    return f"SELECT {by + ',' if by else ''} count(*) AS rows, {listed} FROM ({GUESSES}) g {'GROUP BY ' + by if by else ''}"


GUESSES = """SELECT o_orderpriority, o_totalprice AS y,
  greatest(o_totalprice * (1 + CAST(o_orderkey % 61 - 25 AS DOUBLE) / 100), 0) AS p FROM orders"""


def features(source: str) -> str:
    sqft, bhk, bath = "coalesce(total_sqft, 1000)", "coalesce(bhk, 2)", "coalesce(bath, 2)"

    def half_even(x: str) -> str:
        return f"round_even(({x}) * 100, 0) / 100"

    return f"""SELECT {normal('area_type')} AS area_type, {normal('availability_status')} AS availability_status,
      {r(f'{bhk} + {bath}')} AS total_rooms, {r(half_even(f'{sqft} / greatest({bhk}, 1.0::DOUBLE)'))} AS sqft_per_bhk,
      {r(half_even(f'{bath} / greatest({bhk}, 1.0::DOUBLE)'))} AS bath_per_bhk,
      {r(half_even(f'{sqft} / greatest({bhk} + {bath}, 1.0::DOUBLE)'))} AS sqft_per_room,
      {r(half_even(f'{bath} - {bhk}'))} AS bhk_bath_diff FROM ({source}) f"""


def scaled(centre: str, spread: str) -> str:
    columns = LINE_NUMBERS[:3]
    fitted = ", ".join(f"{centre.format(c=c)} AS c_{c}, {spread.format(c=c)} AS s_{c}" for c in columns)
    out = ", ".join(
        f"{r(f'{f}(({c} - c_{c}) / s_{c})')} AS {f}_{c}" for c in columns for f in ("avg", "min", "max")
    )
    return f"""WITH fit AS (SELECT {fitted} FROM lineitem)
      SELECT l_returnflag, l_linestatus, {out} FROM lineitem, fit GROUP BY 1, 2"""


def labelled(slot: str) -> str:
    name = f"replace(replace({slot}, 'num__', ''), 'cat__', '')"
    known = " ".join(f"WHEN {name} = '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items())
    return f"""CASE {known} WHEN starts_with({name}, 'area_type_') THEN 'Area type: ' || substr({name}, 11)
      WHEN starts_with({name}, 'location_') THEN 'Locality: ' || substr({name}, 10)
      WHEN starts_with({name}, 'availability_status_') THEN 'Availability: ' || substr({name}, 21)
      ELSE {title(f"replace({name}, '_', ' ')")} END"""


_X = ["l_quantity", "l_discount", "CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"]


def slots(contributions: list[str]) -> str:
    """Long attribution rows of every order line, one per slot."""
    return " UNION ALL ".join(
        f"SELECT {KEYS}, {i} AS slot, '{_NAMES[i]}' AS raw_feature, CAST({_X[i]} AS DOUBLE) AS feature_value, "
        f"CAST({contributions[i]} AS DOUBLE) AS contribution FROM lineitem"
        for i in range(3)
    )


LINEAR = slots([f"CAST({w} AS DOUBLE) * (({x}) - CAST({m} AS DOUBLE))" for w, x, m in zip(_WEIGHTS, _X, _MEANS)])

# Shapley values of the two fixed trees: expectations over known / unknown features.
# Tree 1: 1 if quantity <= 25, else 2 / 5 by discount <= .05 (shares .6 .4, .25 .75).
_Q, _D = "(CASE WHEN l_quantity <= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "(CASE WHEN l_discount <= 0.05 THEN 2.0::DOUBLE ELSE 5.0::DOUBLE END)"
_BOTH = f"({_Q} + (1 - {_Q}) * {_D})"
_ONLY_Q = f"({_Q} + (1 - {_Q}) * 4.25)"
_ONLY_D = f"(0.6 + 0.4 * {_D})"
_NONE = "(0.6 + 0.4 * 4.25)"
TREES = slots([
    f"(({_ONLY_Q} - {_NONE}) + ({_BOTH} - {_ONLY_D})) / 2",
    f"(({_ONLY_D} - {_NONE}) + ({_BOTH} - {_ONLY_Q})) / 2",
    "0.5 * ((CASE WHEN l_returnflag = 'R' THEN 3.0 ELSE -1.0 END) - (0.75 * -1 + 0.25 * 3))",
])


def importance(rows: str) -> str:
    return f"""SELECT {labelled('raw_feature')} AS feature, raw_feature, {r('avg(abs(contribution))', 6)} AS mean_abs_shap
      FROM ({rows}) s GROUP BY raw_feature"""


def ridge(alpha: float) -> str:
    n = "n"
    return f"""WITH rows AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem),
    m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + {alpha} AS saa,
      var_pop(b) * count(*) + {alpha} AS sbb, covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say,
      covar_pop(b, y) * count(*) AS sby FROM rows),
    w AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS w1,
      (sby * saa - say * sab) / (saa * sbb - sab * sab) AS w2 FROM m)
    SELECT {r('w1')} AS w1, {r('w2')} AS w2, {r('my - w1 * ma - w2 * mb')} AS intercept FROM w"""


def report_rows(section: str, column: str, metric: str, value: str, source: str, detail: str = "NULL", where: str = "") -> str:
    return f"""SELECT '{section}' AS section, {column} AS column_name, '{metric}' AS metric, {r(value)} AS value,
      CAST({detail} AS VARCHAR) AS detail FROM ({source}) t {where}"""


def inspect() -> str:
    listing = ", ".join(LISTING_TYPES)
    table = copies(DIRTY, listing)
    cells = gaps(DIRTY, list(LISTING_TYPES))
    none = "CAST(NULL AS VARCHAR)"
    types = " UNION ALL ".join(
        f"SELECT 'inspect', '{c}', 'data_type', {float(i)}::DOUBLE, '{t}'" for i, (c, t) in enumerate(LISTING_TYPES.items())
    )
    return " UNION ALL ".join([
        report_rows("inspect", none, "row_count", "total", table),
        report_rows("inspect", none, "column_count", str(len(LISTING_TYPES)), "SELECT 1"),
        report_rows("inspect", none, "duplicate_count", "extra", table), types,
        report_rows("inspect", "column_name", "missing_count", "missing_count", cells),
        report_rows("inspect", "column_name", "missing_pct", "missing_count * 100.0 / row_count", cells),
    ])


def validation() -> str:
    columns = ["location", "total_sqft", "bath", "balcony", "bhk", "area_type", "availability_status", "price"]
    source = f"SELECT {', '.join(columns)} FROM ({PARSED}) p"
    cells = f"SELECT * FROM ({gaps(source, columns)}) c WHERE missing_count > 0"
    critical = "CASE WHEN column_name IN ('price', 'location') THEN 1 ELSE 0 END"
    none = "CAST(NULL AS VARCHAR)"
    table = copies(source, ", ".join(columns))
    bounds = fences(source, ["total_sqft", "bath", "balcony", "bhk", "price"])
    parts = [
        report_rows("validation", none, "is_valid",
                    f"(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM ({cells}) k WHERE column_name IN ('price', 'location'))",
                    "SELECT 1"),
        report_rows("validation", none, "total_rows", "count(*)", source),
        report_rows("validation", none, "total_columns", str(len(columns)), "SELECT 1"),
        report_rows("validation", none, "total_missing_cells", "sum(missing_count)", cells),
        report_rows("missing", "column_name", "missing_count", "missing_count", cells),
        report_rows("missing", "column_name", "missing_pct", "missing_count * 100.0 / row_count", cells),
        report_rows("missing", "column_name", "critical", critical, cells),
        report_rows("duplicates", none, "duplicate_count", "extra", table),
        report_rows("duplicates", none, "duplicate_pct", "extra * 100.0 / total", table),
        report_rows("impossible", "'excessive_bathrooms_count'", "violations", "count(*)", source, where="WHERE bath > bhk + 3"),
    ]
    parts += [
        report_rows("outliers", "column_name", m, m, bounds)
        for m in ("q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_pct")
    ]
    return " UNION ALL ".join(parts)


def categories(columns: list[str], target: str) -> str:
    tables = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {c} AS category, count(*) AS frequency, count({target}) AS count_target,
        avg({target}) AS mt, median({target}) AS med, stddev_samp({target}) AS st FROM part
        WHERE {c} IS NOT NULL GROUP BY {c}""" for c in columns
    )
    ranked = " UNION ALL ".join(
        f"""SELECT *, '{name}' AS ranking, CAST(row_number() OVER (PARTITION BY column_name ORDER BY {by} DESC, category)
        AS INTEGER) AS position FROM t""" for name, by in (("frequency", "frequency"), ("target", "med"))
    )
    return f"""WITH t AS ({tables}), u AS (SELECT column_name, count(*) AS unique_count FROM t GROUP BY 1)
      SELECT column_name, category, frequency, count_target, {r('mt')} AS mean_target, {r('med')} AS median_target,
        {r('st')} AS std_target, ranking, position, unique_count
      FROM ({ranked}) x JOIN u USING (column_name) WHERE position <= 10"""


def tallied(sql: str) -> str:
    return f"SELECT *, count(*) AS n FROM ({sql}) t GROUP BY ALL"


def statements() -> dict[str, str]:
    dirty_names = f"SELECT {place('location')} AS location FROM ({DIRTY}) d"
    split = split_order(f"({PARSED})", LISTING_KEYS, 42)
    train_places = f"""WITH s AS ({split}), p AS (SELECT *, {place('location')} AS name, place <= ceil(0.2::DOUBLE * total) AS test FROM s),
      known AS (SELECT name AS k FROM p WHERE NOT test GROUP BY 1 HAVING count(*) >= 12)"""
    hot_places = train_places.replace(">= 12", ">= 10")
    flags = ["area_type", "availability_status"]
    active = " UNION ALL ".join(
        f"""SELECT 'cat__{c}_' || {normal(c)} AS raw_feature FROM p WHERE test
        AND {normal(c)} IN (SELECT {normal(c)} FROM p WHERE NOT test)""" for c in flags
    )
    fold = "CASE WHEN name IN (SELECT k FROM known) THEN name ELSE 'Other' END"
    columns4 = ["total_sqft", "bath", "balcony", "bhk"]
    filled = ", ".join(
        f"{r(f'{f}(coalesce({c}, m_{c}))', 2)} AS {f}_{c}" if f != "count" else f"count(coalesce({c}, m_{c})) AS count_{c}"
        for c in columns4 for f in ("sum", "min", "count")
    )
    lines_fold = split_order("orders", ["o_orderkey"], 42)
    unit = "l_extendedprice / l_quantity"
    problems = [
        ("total_sqft > 0", "total_sqft must be greater than 0"), ("bhk - 1 > 0", "bhk must be greater than 0"),
        ("bath >= 0", "bath must be 0 or more"), ("balcony >= 0", "balcony must be 0 or more"),
    ]
    errors = ", ".join(f"CASE WHEN coalesce({ok}, FALSE) THEN NULL ELSE '{m}' END" for ok, m in problems)
    linear_rank = f"""SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY abs(contribution) DESC, slot) AS rank
      FROM ({LINEAR}) s WHERE NOT (starts_with(raw_feature, 'cat__') AND abs(feature_value - 1) > 1e-8 + 1e-5)
      AND abs(contribution) > 1e-8"""
    return {
        "parse_size": tallied(f"SELECT size, {size_count('size')} AS bhk FROM ({DIRTY}) d"),
        "parse_area": tallied(f"SELECT total_sqft, {r(area('total_sqft'))} AS sqft FROM ({DIRTY}) d"),
        "clean_status": tallied(f"SELECT availability, {status('availability')} AS status FROM ({DIRTY}) d"),
        "normalize_location": tallied(f"SELECT location, {place('location')} AS name FROM ({DIRTY}) d"),
        "normalize_area_type": tallied(
            f"SELECT area_type, trim(coalesce(area_type, 'Super built-up Area')) AS defaulted, "
            f"{normal('area_type')} AS normalized FROM ({DIRTY}) d"
        ),
        "feature_labels": tallied(f"""SELECT slot, {labelled('slot')} AS label FROM (
            SELECT unnest(['cat__location_' || {place('location')}, 'cat__area_type_' || {normal('area_type')},
              'cat__availability_status_' || {status('availability')}, 'num__sqft_per_bhk', 'num__garden_size']) AS slot
            FROM ({DIRTY}) d) s WHERE slot IS NOT NULL"""),
        "csv_round_trip": f"""SELECT {', '.join(
            f"{r(c)} AS {c}" if kind == "double" else c for c, kind in LISTING_TYPES.items())} FROM ({DIRTY}) d""",
        "missing_values": f"""SELECT column_name, missing_count, {r('missing_count * 100.0 / row_count')} AS missing_pct,
            column_name IN ('price', 'location') AS critical FROM ({gaps(DIRTY, list(LISTING_TYPES))}) g WHERE missing_count > 0""",
        "duplicate_rows": f"""SELECT total AS row_count, extra AS duplicate_count, {r('extra * 100.0 / total')} AS duplicate_pct
            FROM ({copies(DIRTY, ', '.join(LISTING_TYPES))}) c""",
        "duplicate_keys": f"""SELECT total AS row_count, extra AS duplicate_count, {r('extra * 100.0 / total')} AS duplicate_pct
            FROM ({copies('SELECT * FROM lineitem', 'l_orderkey, l_linenumber')}) c""",
        "domain_rules": f"SELECT 'excessive_bathrooms_count' AS rule, count(*) AS violations FROM ({PARSED}) p WHERE bath > bhk + 3",
        "custom_rules": """SELECT rule, count(*) AS violations FROM (
            SELECT 'overdrawn' AS rule FROM customer WHERE c_acctbal < 0
            UNION ALL SELECT 'unnamed' FROM customer WHERE c_name IS NULL
            UNION ALL SELECT 'rich_builder' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) v GROUP BY 1""",
        "inspect_table": inspect(),
        "validation_report": validation(),
        "iqr_outliers": fences("SELECT * FROM lineitem", LINE_NUMBERS),
        "iqr_outliers_bracketed": fences("SELECT * FROM lineitem", LINE_NUMBERS),
        "clean_listings": f"""WITH {judged()} SELECT location, {r('total_sqft')} AS total_sqft, bath, balcony, bhk,
            area_type, availability_status, {r('price')} AS price FROM judged WHERE verdict = 'kept'""",
        "clean_report": clean_report(True, 10),
        "clean_report_keep_duplicates": clean_report(False, 5),
        "fold_rare_categories": f"""WITH v AS ({dirty_names}), f AS (SELECT location AS k FROM v GROUP BY 1 HAVING count(*) >= 15)
            SELECT location, count(*) AS n FROM (SELECT CASE WHEN location IN (SELECT k FROM f) THEN location ELSE 'Other' END
            AS location FROM v) x GROUP BY 1""",
        "impute_group_median": f"""WITH p AS ({PARSED}), m AS (SELECT bhk AS g, median(bath) AS mb, median(balcony) AS ml FROM p GROUP BY 1)
            SELECT bhk, CAST(trunc(coalesce(bath, mb, bhk)) AS INTEGER) AS bath,
              CAST(trunc(coalesce(balcony, ml, 1)) AS INTEGER) AS balcony, count(*) AS n
            FROM p LEFT JOIN m ON bhk = g GROUP BY ALL""",
        "dataset_overview": f"""SELECT 'total_rows' AS fact, CAST(count(*) AS VARCHAR) AS value FROM ({DIRTY}) d
            UNION ALL VALUES ('total_columns', '9'), ('columns', '{','.join(LISTING_TYPES)}'),
              ('numerical_columns', '{','.join(c for c, t in LISTING_TYPES.items() if t == 'double')}'),
              ('categorical_columns', '{','.join(c for c, t in LISTING_TYPES.items() if t == 'string')}')""",
        "target_stats": target_stats("orders", "o_totalprice", 3),
        "target_stats_skewed": target_stats("events", "value", 4),
        "numeric_summary": numeric_summary("part", ["p_size", "p_retailprice"]),
        "numeric_summary_bracketed": numeric_summary("lineitem", LINE_NUMBERS[:3], 3),
        "categorical_summary": categories(["p_brand", "p_type", "p_name"], "p_retailprice"),
        "correlation": correlation("SELECT * FROM lineitem", [*LINE_NUMBERS, "l_suppkey"]),
        "correlation_with_gaps": correlation(PARSED, ["total_sqft", "bath", "balcony", "bhk", "price"]),
        "correlation_spearman": correlation("""SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS p_size,
            rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS p_retailprice
            FROM part""", ["p_size", "p_retailprice"]),
        "unit_price": f"SELECT l_returnflag, {r(f'sum({unit})', 3)} AS total, {r(f'max({unit})', 3)} AS highest FROM lineitem GROUP BY 1",
        "location_stats_top": group_stats("p_type", 15, "DESC"),
        "location_stats_bottom": group_stats("p_type", 15, "ASC"),
        "brand_stats_top": group_stats("p_brand", 15, "DESC"),
        "brand_stats_bottom": group_stats("p_brand", 15, "ASC"),
        "location_stats_counts": f"""SELECT count(*) AS total_unique, count(*) FILTER (n >= 25) AS qualified_count
            FROM (SELECT l_partkey, count(price) AS n FROM ({SALES}) s GROUP BY 1) g""",
        "location_stats_bracketed": group_stats("l_partkey", 25),
        "market_summary": f"""SELECT n_name, count(*) AS properties, {r('median(price)', 3)} AS median_price,
            {r('avg(price)', 3)} AS mean_price FROM ({SALES}) s GROUP BY 1 ORDER BY median(price) DESC, n_name LIMIT 15""",
        "market_snapshot": " UNION ALL ".join(
            f"SELECT '{name}' AS metric, {r(value, 3)} AS value FROM ({SALES}) s" for name, value in (
                ("records", "count(*)"), ("median_price", "median(price)"), ("mean_price", "avg(price)"),
                ("localities", "count(DISTINCT n_name)"))),
        "distinct_values": f"SELECT DISTINCT p_type FROM ({SALES}) s WHERE p_type IS NOT NULL",
        "top_categories": "SELECT p_type, count(*) AS frequency FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "frequent_groups_only": f"SELECT l_partkey, count(*) AS n, {r('sum(l_quantity)')} AS quantity FROM lineitem GROUP BY 1 HAVING count(*) >= 35",
        "histogram": histogram("SELECT o_totalprice AS value FROM orders", 40),
        "histogram_log": histogram("SELECT ln(1 + o_totalprice) AS value FROM orders", 40),
        "histogram_in_range": histogram(
            f"SELECT price_per_sqft AS value FROM ({SALES}) s WHERE price_per_sqft BETWEEN 120000000 AND 180000000", 50, 2),
        "histogram_median": f"SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS n, {r('median(o_totalprice)')} AS median FROM orders",
        "histogram_median_in_range": f"""SELECT 'price_per_sqft' AS column_name, count(*) AS n, {r('median(price_per_sqft)', 2)} AS median
            FROM ({SALES}) s WHERE price_per_sqft BETWEEN 120000000 AND 180000000""",
        "box_stats": box_stats("events", "event_type", "value", 4),
        "box_stats_bracketed": box_stats("lineitem", "l_returnflag", "l_extendedprice", 3),
        "binned_scatter": f"""SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS x_bin, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS y_bin,
            l_returnflag, count(*) AS points, {r('avg(l_extendedprice)')} AS mean_y FROM lineitem WHERE l_quantity <= 40 GROUP BY 1, 2, 3""",
        "bar_ranking": f"""SELECT l_partkey, {r('median(price)')} AS median_value FROM ({SALES}) s GROUP BY 1
            HAVING count(*) >= 25 ORDER BY median(price) DESC, l_partkey LIMIT 15""",
        "unit_price_ranking": f"""SELECT l_partkey, {r('median(price_per_sqft)', 2)} AS median_value FROM ({SALES}) s GROUP BY 1
            HAVING count(*) >= 25 ORDER BY median(price_per_sqft) DESC, l_partkey LIMIT 15""",
        "engineer_features": f"SELECT *, count(*) AS n FROM ({features(PARSED)}) f GROUP BY ALL",
        "rare_fold_fit_apply": f"{train_places} SELECT {fold} AS location, count(*) AS n FROM p WHERE test GROUP BY 1",
        "median_impute": f"""WITH p AS ({PARSED}), m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in columns4)} FROM p)
            SELECT {filled} FROM p, m""",
        "robust_scale": scaled("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
        "standard_scale": scaled("avg({c})", "stddev_pop({c})"),
        "one_hot_active": f"""{hot_places}, l AS (SELECT test, {fold} AS loc FROM p)
            SELECT raw_feature, count(*) AS n FROM (
              SELECT 'cat__location_' || loc AS raw_feature FROM l WHERE test AND loc IN (SELECT loc FROM l WHERE NOT test)
              UNION ALL {active}) a GROUP BY 1""",
        "separate_target": f"SELECT {KEYS}, {r('ln(1 + greatest(price, 0))')} AS label, {r('price')} AS actual FROM ({PARSED}) p",
        "model_ready": f"""SELECT CASE WHEN place <= ceil(0.2::DOUBLE * total) THEN 'test' ELSE 'train' END AS side, count(*) AS n,
            {r('max(price)')} AS dearest FROM ({split}) s GROUP BY 1""",
        "target_round_trip": f"""SELECT o_orderkey, {r('t', 3)} AS log_target, {r('greatest(exp(t - 1) - 1, 0)', 3)} AS restored,
            {r('v', 3)} AS clipped FROM (SELECT o_orderkey, greatest(o_totalprice - 50000, 0) AS v,
            ln(1 + greatest(o_totalprice - 50000, 0)) AS t FROM orders) x""",
        "split_assign": f"""SELECT o_orderkey, CASE WHEN place <= ceil(0.2::DOUBLE * total) THEN 'test' ELSE 'train' END AS split
            FROM ({lines_fold}) s""",
        "split_assign_multi_key": f"""SELECT {KEYS}, CASE WHEN place <= ceil(0.1::DOUBLE * total) THEN 'test' ELSE 'train' END AS split
            FROM ({split_order('lineitem', LISTING_KEYS, 7)}) s""",
        "kfold_assign": f"""SELECT o_orderkey, CAST(CASE WHEN place <= (total % 5) * (total // 5 + 1)
            THEN (place - 1) // (total // 5 + 1) ELSE total % 5 + (place - 1 - (total % 5) * (total // 5 + 1)) // (total // 5) END
            AS INTEGER) AS fold FROM ({lines_fold}) s""",
        "regression_metrics": metrics(),
        "regression_metrics_by_group": metrics("o_orderpriority"),
        "regression_metrics_bracketed": metrics("o_orderpriority"),
        "residual_band": f"SELECT 0.9::DOUBLE AS q, {r('quantile_cont(abs(y - p), 0.9)', 3)} AS band FROM ({GUESSES}) g",
        "ridge_fit": ridge(5000.0),
        "validate_inputs": f"""SELECT problems, problems = '' AS valid, count(*) AS n FROM (
            SELECT concat_ws('; ', {errors}) AS problems FROM ({PARSED}) p) x GROUP BY 1, 2""",
        "score_band": f"""SELECT o_orderkey, {r('p', 8)} AS predicted_price, {r('p / 100', 8)} AS predicted_crore,
            {r('greatest(p - 64.264::DOUBLE, 0)', 8)} AS interval_low, {r('p + 64.264::DOUBLE', 8)} AS interval_high
            FROM (SELECT o_orderkey, o_totalprice / 1000 AS p FROM orders) x""",
        "linear_attribution": f"SELECT {KEYS}, slot, raw_feature, {r('feature_value', 6)} AS feature_value, {r('contribution', 6)} AS contribution FROM ({LINEAR}) s",
        "explain_topn": f"""SELECT {KEYS}, CAST(rank AS INTEGER) AS rank, {labelled('raw_feature')} AS feature, raw_feature,
            {r('contribution', 6)} AS shap_value_log_price, CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END AS impact,
            {r('abs(contribution)', 6)} AS magnitude, TRUE AS is_active FROM ({linear_rank}) x WHERE rank <= 2""",
        "global_importance": importance(LINEAR),
        "tree_attribution": f"SELECT {KEYS}, slot, raw_feature, {r('feature_value', 6)} AS feature_value, {r('contribution', 6)} AS contribution FROM ({TREES}) s",
        "tree_importance": importance(TREES),
        "full_profile": f"WITH {judged()}, kept_rows AS (SELECT * FROM judged WHERE verdict = 'kept'), "
        + box_stats("kept_rows", "area_type", "price", 4).removeprefix("WITH "),
    }
