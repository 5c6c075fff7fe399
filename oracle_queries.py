"""DuckDB statements that say independently what each registered query must return.

Every figure is worked out in whole numbers: scores are ten-millionths, and `ratio` rounds a quotient half away from
zero in integer arithmetic, so no statement depends on how an engine rounds or types its averages.
"""

from __future__ import annotations

from agorametric.sources.sample_posts import SQL as SAMPLE_SQL

HOTSPOT_ABOVE = 50
# How often the sample is repeated where a hotspot needs more posts than the published 500.
HOTSPOT_DEFAULT, COPIES = 500, 12

# What replaces a column's text in the spoilt sample where the id is divisible; later entries go before earlier ones.
SPOILT = {
    "lat": {70: "1e30", 71: "abc", 73: "-91.5", 79: "-5.2199999999999995e-05", 83: "12345678901234567890123.5"},
    "lng": {70: "-180.5", 71: "1,5", 73: "-1e25", 79: "-5.2199999999999995e-05"},
    "temperature_avg": {70: "1e3", 71: "n/a", 73: "-400.00000000000000000001", 79: "-5.2199999999999995e-05", 89: "12345678901234567890.25"},
}

# Degrees north, degrees east and years of the posts in `clean_box`.
BOX = (30, 60), (-100, 20), (2010, 2015)

# Fixed value: what counts as a number.
_NUMBER = r"-?[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?"

_RAW = f"WITH raw AS ({SAMPLE_SQL})"

_CLEAN = f"""{_RAW},
parsed AS (
  SELECT *,
    strptime(left(created_at, 19), '%Y-%m-%d %H:%M:%S') AS ts,
    CAST(sentiment AS DECIMAL(10,7)) AS s,
    CAST(nullif(trim(lat), '') AS DECIMAL(10,7)) AS la,
    CAST(nullif(trim(lng), '') AS DECIMAL(10,7)) AS lo,
    CAST(nullif(trim(temperature_avg), '') AS DECIMAL(10,7)) AS t,
    lower(trim(stance)) AS st, lower(trim(gender)) AS ge, lower(trim(aggressiveness)) AS ag
  FROM raw
),
posts AS (
  SELECT id, ts, created_at, la, lo, s, t,
    CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m,
    CAST(s * 10000000 AS HUGEINT) AS s7, CAST(t * 10000000 AS HUGEINT) AS t7,
    la IS NOT NULL AND lo IS NOT NULL AS geo,
    array_to_string(list_transform(
      regexp_extract_all(lower(trim(topic)), '([\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+)', 1),
      lambda w: concat(upper(w[1]), w[2:])), '') AS topic,
    CASE WHEN s BETWEEN -0.05 AND 0.05 OR s IS NULL THEN 'Neutral' WHEN s > 0 THEN 'Positive' ELSE 'Negative' END AS mood,
    CASE WHEN st IN ('believer', 'denier', 'neutral') THEN upper(st[1]) || st[2:] ELSE 'Unknown' END AS stance,
    CASE WHEN ge IN ('male', 'female') THEN upper(ge[1]) || ge[2:] ELSE 'Unknown' END AS gender,
    coalesce(map {{'aggressive': 'Aggressive', 'not aggressive': 'Not Aggressive'}}[ag], 'Unknown') AS aggressiveness,
    ag = 'aggressive' AS hot,
    -- Fixed values: region rectangles; the first that holds a point names it.
    coalesce(list_filter([
      CASE WHEN la IS NULL OR lo IS NULL THEN 'Unknown' END,
      CASE WHEN la >= 15 AND la <= 72 AND lo >= -170 AND lo <= -50 THEN 'North America' END,
      CASE WHEN la >= -60 AND la <= 15 AND lo >= -90 AND lo <= -30 THEN 'South America' END,
      CASE WHEN la >= 35 AND la <= 70 AND lo >= -25 AND lo <= 40 THEN 'Europe' END,
      CASE WHEN la >= -35 AND la <= 37 AND lo >= -20 AND lo <= 55 THEN 'Africa' END,
      CASE WHEN la >= 5 AND la <= 80 AND lo >= 40 AND lo <= 180 THEN 'Asia' END,
      CASE WHEN la >= -50 AND la <= -5 AND lo >= 110 AND lo <= 180 THEN 'Oceania' END
    ], lambda name: name IS NOT NULL)[1], 'Other') AS continent
  FROM parsed
)"""


def ratio(top: str, bottom: str, digits: int) -> str:
    """top / bottom rounded half away from zero; NULL if bottom is 0."""
    scale = 10**digits
    return (
        f"CAST((CASE WHEN ({top}) < 0 THEN -1 ELSE 1 END)"
        f" * ((2 * abs({top}) * {scale} + ({bottom})) // nullif(2 * ({bottom}), 0)) AS DOUBLE) / {scale}"
    )


def ratio_text(top: str, bottom: str, digits: int) -> str:
    """As `ratio`, as text, which a double does not cut."""
    scale = 10**digits
    size = f"((2 * abs({top}) * {scale} + ({bottom})) // nullif(2 * ({bottom}), 0))"
    sign = f"CASE WHEN ({top}) < 0 AND {size} > 0 THEN '-' ELSE '' END"
    return f"{sign} || CAST({size} // {scale} AS VARCHAR) || '.' || lpad(CAST({size} % {scale} AS VARCHAR), {digits}, '0')"


def tally(condition: str) -> str:
    return f"CAST(coalesce(sum(CAST({condition} AS INT)), 0) AS HUGEINT)"


ROWS = "CAST(count(*) AS HUGEINT)"
BELIEVERS, DENIERS, NEUTRALS = (tally(f"stance = '{name}'") for name in ("Believer", "Denier", "Neutral"))
HOT = tally("hot")


def whole(text: str) -> str:
    return f"CAST({text} AS BIGINT)"


def share(part: str, all_rows: str = ROWS, digits: int = 2) -> str:
    return ratio(f"100 * ({part})", all_rows, digits)


def mean(column: str, digits: int = 4) -> str:
    """Average of a column held in ten-millionths."""
    return ratio(f"CAST(sum({column}) AS HUGEINT)", f"(CAST(count({column}) AS HUGEINT) * 10000000)", digits)


def spread(digits: int = 4) -> str:
    return f"round(stddev_samp(CAST(s AS DOUBLE)), {digits}) + 0.0"


def balance() -> str:
    smaller = f"least({BELIEVERS}, {DENIERS})"
    return f"coalesce({ratio(f'2 * {smaller}', f'({BELIEVERS} + {DENIERS})', 4)}, 1.0)"


def known_rate(digits: int, scale: int = 1) -> str:
    return ratio(f"{scale} * {HOT}", "CAST(count(hot) AS HUGEINT)", digits)


def grouped(keys: str, columns: dict[str, str], source: str = "posts", where: str = "", having: str = "") -> str:
    """A grouped select over the clean posts; `keys` are 'expression AS name' parts."""
    names = [part.strip() for part in keys.split(";") if part.strip()]
    listed = ", ".join(names + [f"{text} AS {name}" for name, text in columns.items()])
    text = f"SELECT {listed} FROM {source}"
    if where:
        text += f" WHERE {where}"
    if names:
        text += " GROUP BY " + ", ".join(part.rsplit(" AS ", 1)[0] for part in names)
    if having:
        text += f" HAVING {having}"
    return text


_STUDY = "y BETWEEN 2006 AND 2019"
_NAMED = "continent NOT IN ('Unknown', 'Other')"


def _replaced(column: str) -> str:
    cases = " ".join(f"WHEN id % {step} = 0 THEN '{text}'" for step, text in reversed(SPOILT[column].items()))
    return f"CASE {cases} ELSE {column} END AS {column}"


_SPOILT = (
    f"spoilt AS (SELECT * REPLACE ({', '.join(map(_replaced, SPOILT))},"
    " CASE WHEN id % 501 = 0 THEN NULL WHEN id % 97 = 0 THEN id // 2 ELSE id END AS id) FROM raw)"
)


def _number_profile(column: str, suffix: str, limit: int | None, average: bool, source: str = "raw") -> str:
    start = _RAW if source == "raw" else f"{_RAW}, {_SPOILT}"
    checked = (
        f"{start}, checked AS (SELECT {column} AS x, regexp_full_match({column}, '{_NUMBER}') AS ok,"
        f" CASE WHEN regexp_full_match({column}, '{_NUMBER}') THEN CAST({column} AS DOUBLE) END AS d,"
        f" CASE WHEN regexp_full_match({column}, '{_NUMBER}') THEN TRY_CAST({column} AS DECIMAL(38,9)) END AS v FROM {source})"
    )
    columns = [
        f"{whole('count(*)')} AS total",
        f"{whole(tally('''trim(coalesce(x, '')) = '' '''))} AS null_or_blank",
        f"{whole(tally('''trim(x) <> '' AND NOT ok'''))} AS non_numeric",
    ]
    if limit is not None:
        columns.append(f"{whole(tally(f'ok AND abs(d) > {limit}'))} AS out_of_range")
    columns += [f"min(d) AS min_{suffix}", f"max(d) AS max_{suffix}"]
    if average:
        units = "CAST(replace(CAST(v AS VARCHAR), '.', '') AS HUGEINT)"
        average = ratio_text(f"CAST(sum({units}) AS HUGEINT)", "(CAST(count(v) AS HUGEINT) * 1000000000)", 4)
        columns.append(f"CAST({average} AS DOUBLE) AS avg_{suffix}")
    return f"{checked} SELECT {', '.join(columns)} FROM checked"


def _exact_numbers(*columns: str) -> str:
    """Exact figures as texts; numbers of up to 21 decimals and 17 digits before the point."""
    each = " UNION ALL ".join(
        f"SELECT '{name}' AS col, CASE WHEN regexp_full_match({name}, '{_NUMBER}') THEN {name} END AS x FROM raw" for name in columns
    )
    units = "CAST(replace(CAST(v AS VARCHAR), '.', '') AS HUGEINT)"
    average = ratio_text(f"CAST(sum({units}) AS HUGEINT)", f"(CAST(count(v) AS HUGEINT) * CAST({10**21} AS HUGEINT))", 4)
    return (
        f"{_RAW}, listed AS (SELECT col, x, CAST(x AS DECIMAL(38,21)) AS v FROM ({each}))"
        f" SELECT col, {whole('count(v)')} AS n_numbers, min({{'v': v, 'x': x}}).x AS least, max({{'v': v, 'x': x}}).x AS greatest,"
        f" rtrim(rtrim(CAST(sum(v) AS VARCHAR), '0'), '.') AS total, {average} AS average"
        " FROM listed WHERE v IS NOT NULL GROUP BY col"
    )


def _raw_statements() -> dict[str, str]:
    stacked = " UNION ALL ".join(
        f"SELECT '{name}' AS col, coalesce({name}, 'NULL') AS val, {whole('count(*)')} AS n,"
        f" {share(ROWS, '(SELECT CAST(count(*) AS HUGEINT) FROM raw)', 4)} AS pct FROM raw GROUP BY {name}"
        for name in ("stance", "gender", "aggressiveness")
    )
    valid = tally(f"regexp_full_match(sentiment, '{_NUMBER}')")
    exact = "CAST(CAST(sentiment AS DECIMAL(10,7)) * 10000000 AS HUGEINT)"
    return {
        "ingest_csv": f"{_RAW} SELECT * REPLACE ({whole('id')} AS id) FROM raw",
        "raw_row_count": f"{_RAW} SELECT {whole('count(*)')} AS total_imported_rows FROM raw",
        "raw_preview": f"{_RAW} SELECT * FROM raw ORDER BY id LIMIT 10",
        "audit_created_at_format": f"{_RAW} SELECT left(created_at, 30) AS sample_format, {whole('count(*)')} AS"
        " occurrences FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        "audit_id": f"{_RAW} SELECT {whole('count(*)')} AS total, {whole(tally('id IS NULL'))} AS null_ids,"
        " min(id) AS min_id, max(id) AS max_id FROM raw",
        "audit_numbers": _exact_numbers("lat", "lng", "temperature_avg", "sentiment"),
        "ingest_csv_breaks": f"{_RAW} SELECT * REPLACE ({whole('id')} AS id, CASE WHEN id % 7 = 0 THEN 'a \"'"
        " || chr(10) || chr(10) || '1,2' || chr(10) || topic ELSE topic END AS topic) FROM raw",
        "audit_lat": _number_profile("lat", "lat", 90, False),
        "audit_lng": _number_profile("lng", "lng", 180, False),
        "audit_temperature": _number_profile("temperature_avg", "temp", None, True),
        "audit_lat_spoilt": _number_profile("lat", "lat", 90, False, "spoilt"),
        "audit_lng_spoilt": _number_profile("lng", "lng", 180, False, "spoilt"),
        "audit_temperature_spoilt": _number_profile("temperature_avg", "temp", None, True, "spoilt"),
        "key_clashes": f"{_RAW}, {_SPOILT} SELECT DISTINCT id FROM spoilt WHERE id IN (SELECT id FROM raw WHERE id % 3 > 0)",
        "key_violations": f"{_RAW}, {_SPOILT} SELECT id, {whole('count(*)')} AS n FROM spoilt"
        " GROUP BY id HAVING id IS NULL OR count(*) > 1",
        "audit_sentiment": f"{_RAW} SELECT {whole('count(*)')} AS total,"
        f" {whole(tally('''trim(coalesce(sentiment, '')) = '' '''))} AS null_or_blank,"
        f" {whole('count(sentiment)')} AS non_null_rows, {whole(valid)} AS valid_numeric,"
        f" {whole(f'count(*) - {valid}')} AS problem_rows,"
        f" CAST(min({exact}) AS DOUBLE) / 10000000 AS min_sentiment,"
        f" CAST(max({exact}) AS DOUBLE) / 10000000 AS max_sentiment,"
        f" {ratio(f'sum({exact})', 'count(sentiment) * CAST(10000000 AS HUGEINT)', 6)} AS avg_sentiment FROM raw",
        "audit_categories": f"{_RAW} {stacked}",
        "audit_topic": f"{_RAW} SELECT coalesce(topic, 'NULL') AS topic_value, {whole('count(*)')} AS occurrences"
        " FROM raw GROUP BY topic",
        "audit_duplicates": f"{_RAW}, per_id AS (SELECT id, count(*) AS n FROM raw GROUP BY id)"
        f" SELECT {whole('sum(n)')} AS total_rows, {whole('count(id)')} AS distinct_ids,"
        f" {whole('sum(n) - count(id)')} AS duplicate_rows FROM per_id",
    }


_CLEAN_ROWS = (
    "SELECT id AS tweet_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tweet_timestamp,"
    " strftime(ts, '%Y-%m-%d') AS tweet_date, y AS tweet_year, m AS tweet_month, (m + 2) // 3 AS tweet_quarter,"
    " CAST(isodow(ts) % 7 AS BIGINT) AS tweet_day_of_week, CAST(la AS DOUBLE) AS lat, CAST(lo AS DOUBLE) AS lng,"
    " geo AS has_coordinates, topic, CAST(s AS DOUBLE) AS sentiment_score, mood AS sentiment_category, stance, gender,"
    " aggressiveness, hot AS is_aggressive, CAST(t AS DOUBLE) AS temperature_avg, continent,"
    " created_at AS created_at_raw FROM posts"
)


def _validation_statements() -> dict[str, str]:
    columns = {
        "stance": "stance",
        "gender": "gender",
        "aggressiveness": "aggressiveness",
        "sentiment_category": "mood",
        "continent": "continent",
    }
    stacked = " UNION ALL ".join(
        f"SELECT '{name}' AS col, {column} AS val, {whole('count(*)')} AS n FROM posts GROUP BY {column}"
        for name, column in columns.items()
    )
    unknown = {f"unknown_{name}": whole(tally(f"{name} = 'Unknown'")) for name in ("gender", "stance", "continent")}
    return {
        "clean_tweets": _CLEAN_ROWS,
        "clean_layout": _CLEAN_ROWS,
        "clean_reconcile": f"SELECT {whole('(SELECT count(*) FROM raw)')} AS raw_rows,"
        f" {whole('count(*)')} AS clean_rows,"
        f" {whole('(SELECT count(*) FROM raw) - count(*)')} AS difference FROM posts",
        "clean_year_distribution": grouped("y AS tweet_year", {"tweets": whole("count(*)")}),
        "clean_completeness": grouped(
            "",
            {
                "total": whole("count(*)"),
                "geotagged": whole(tally("geo")),
                "pct_geotagged": share(tally("geo")),
                "null_sentiment": whole("count(*) - count(s)"),
                "null_temp": whole("count(*) - count(t)"),
                **unknown,
            },
        ),
        "clean_categories": stacked,
        "clean_coverage": grouped(
            "",
            {
                "earliest_tweet": "strftime(min(ts), '%Y-%m-%d %H:%M:%S')",
                "latest_tweet": "strftime(max(ts), '%Y-%m-%d %H:%M:%S')",
                "total_years": whole("count(DISTINCT y)"),
            },
        ),
    }


_SIDES = {"believers": whole(BELIEVERS), "deniers": whole(DENIERS)}
_SIDE_SHARES = {"pct_believers": share(BELIEVERS), "pct_deniers": share(DENIERS)}
_HOT_SHARE = {"pct_aggressive": share(HOT)}
_TOTAL = {"total_tweets": whole("count(*)")}
_MEAN = {"avg_sentiment": mean("s7")}

_MONTHS = grouped(
    "y AS tweet_year; m AS tweet_month",
    {
        "year_month": "y || '-' || lpad(CAST(m AS VARCHAR), 2, '0')",
        "season": "['Winter', 'Spring', 'Summer', 'Autumn'][(m % 12) // 3 + 1]",
        **_TOTAL,
        **_MEAN,
        "aggressive_count": whole(HOT),
        **_HOT_SHARE,
    },
    where=_STUDY,
)

_TOPICS = grouped(
    "topic AS topic",
    {
        **_TOTAL,
        **_MEAN,
        "sentiment_volatility": spread(),
        **_SIDES,
        "neutrals": whole(NEUTRALS),
        **_SIDE_SHARES,
        "aggressive_tweets": whole(HOT),
        **_HOT_SHARE,
        "divisiveness_score": balance(),
    },
)

_TOPIC_YEARS = grouped(
    "y AS tweet_year; topic AS topic",
    {
        "tweet_count": whole("count(*)"),
        **_MEAN,
        "aggressive_count": whole(HOT),
        **_HOT_SHARE,
        "pct_believers": share(BELIEVERS),
        "volume_rank": whole("rank() OVER (PARTITION BY y ORDER BY count(*) DESC)"),
    },
    where=_STUDY,
)

_REGIONS = grouped(
    "continent AS continent",
    {
        **_TOTAL,
        **_MEAN,
        "sentiment_volatility": spread(),
        **_SIDES,
        **_SIDE_SHARES,
        "aggressive_tweets": whole(HOT),
        **_HOT_SHARE,
        "avg_temp_deviation": mean("t7"),
        "divisiveness_score": balance(),
    },
    where="continent <> 'Unknown'",
)

_REGION_STANCES = grouped(
    "continent AS continent; y AS tweet_year",
    {**_SIDES, "neutrals": whole(NEUTRALS), "total": whole("count(*)"), **_SIDE_SHARES, **_HOT_SHARE},
    where=_NAMED,
)

_KPIS = grouped(
    "",
    {
        **_TOTAL,
        "years_covered": whole("count(DISTINCT y)"),
        "first_year": "min(y)",
        "last_year": "max(y)",
        "overall_avg_sentiment": mean("s7"),
        "total_believers": whole(BELIEVERS),
        "total_deniers": whole(DENIERS),
        "total_neutrals": whole(NEUTRALS),
        **_SIDE_SHARES,
        "total_aggressive": whole(HOT),
        "overall_aggr_pct": share(HOT),
        "geotagged_tweets": whole(tally("geo")),
        "pct_geotagged": share(tally("geo")),
        "distinct_topics": whole("count(DISTINCT topic)"),
    },
)


def _change(year_filter: str) -> str:
    """Per year: sums, and the change of the mean against the row before as a fraction `up / down`."""
    return (
        "yearly AS (SELECT y, CAST(sum(s7) AS HUGEINT) AS total, CAST(count(s) AS HUGEINT) AS n FROM posts"
        f" WHERE {year_filter} GROUP BY y),"
        " changes AS (SELECT y, total, n, total * lag(n) OVER w - lag(total) OVER w * n AS up,"
        " n * lag(n) OVER w * 10000000 AS down FROM yearly WINDOW w AS (ORDER BY y))"
    )


_YEARS = (
    grouped(
        "y AS tweet_year",
        {
            **_TOTAL,
            **_MEAN,
            "sentiment_volatility": spread(),
            **_SIDES,
            "neutrals": whole(NEUTRALS),
            **_SIDE_SHARES,
            "aggressive_count": whole(HOT),
            **_HOT_SHARE,
        },
        where=_STUDY,
    ),
    ratio("up", "down", 4),
)

_YEARLY = (
    f"{_CLEAN}, {_change(_STUDY)}, years AS ({_YEARS[0]})"
    f" SELECT years.*, {_YEARS[1]} AS yoy_sentiment_change FROM years JOIN changes ON tweet_year = y"
)


def _mart_statements() -> dict[str, str]:
    return {
        "vw_kpi_summary": _KPIS,
        "vw_monthly_trends": _MONTHS,
        "vw_topic_analysis": _TOPICS,
        "vw_topic_yearly_trends": _TOPIC_YEARS,
        "vw_regional_analysis": _REGIONS,
        "vw_stance_by_region": _REGION_STANCES,
        "vw_gender_analysis": grouped(
            "gender AS gender; y AS tweet_year",
            {
                **_TOTAL,
                **_MEAN,
                "aggressive_count": whole(HOT),
                **_HOT_SHARE,
                **_SIDES,
                "pct_believers": share(BELIEVERS),
            },
            where="gender <> 'Unknown'",
        ),
        "vw_temp_sentiment": grouped(
            "y AS tweet_year; continent AS continent",
            {
                "avg_temp_deviation": mean("t7"),
                **_MEAN,
                "aggr_rate": known_rate(4),
                "tweet_count": whole("count(*)"),
            },
            where=f"t IS NOT NULL AND s IS NOT NULL AND {_STUDY}",
        ),
        "vw_aggressiveness_analysis": grouped(
            "y AS tweet_year; topic AS topic; continent AS continent; stance AS stance; gender AS gender",
            {**_TOTAL, "aggressive_count": whole(HOT), **_HOT_SHARE, **_MEAN},
            where=_STUDY,
        ),
        "vw_executive_insights": grouped(
            "topic AS topic",
            {
                **_TOTAL,
                "avg_sentiment": mean("s7", 3),
                "sentiment_volatility": spread(3),
                "aggression_rate": known_rate(3),
                "pct_aggressive": known_rate(2, 100),
                "believer_ratio": ratio(BELIEVERS, f"({BELIEVERS} + {DENIERS})", 3),
                "denier_ratio": ratio(DENIERS, f"({BELIEVERS} + {DENIERS})", 3),
                **_SIDES,
            },
        ),
    }


def _distribution(key: str, count: str, pct: str = "pct", where: str = "true") -> str:
    everything = f"(SELECT CAST(count(*) AS HUGEINT) FROM posts WHERE {where})"
    return grouped(key, {count: whole("count(*)"), pct: share(ROWS, everything)}, where=where)


def _descriptive_statements() -> dict[str, str]:
    everything = "(SELECT CAST(count(*) AS HUGEINT) FROM posts)"
    middle = (
        "(SELECT stance AS st, CAST(sum(s7) AS HUGEINT) * 2 // count(*) AS twice FROM"
        " (SELECT stance, s7, row_number() OVER (PARTITION BY stance ORDER BY s7) AS place,"
        " count(*) OVER (PARTITION BY stance) AS size FROM posts WHERE s7 IS NOT NULL)"
        " WHERE place IN ((size + 1) // 2, size // 2 + 1) GROUP BY stance)"
    )
    figures = grouped(
        "stance AS stance",
        {
            "tweets": whole("count(*)"),
            "min_sentiment": ratio("min(s7)", "CAST(10000000 AS HUGEINT)", 4),
            "max_sentiment": ratio("max(s7)", "CAST(10000000 AS HUGEINT)", 4),
            **_MEAN,
            "stddev_sentiment": spread(),
        },
    )
    return {
        "desc_kpis": _KPIS,
        "desc_volume_by_year": _distribution("y AS tweet_year", "tweets", "pct_of_total"),
        "desc_sentiment_histogram": _distribution(
            "CAST(floor(s7 / 1000000) AS DOUBLE) / 10 + 0.0 AS sentiment_bucket", "tweet_count"
        ),
        "desc_stance": _distribution("stance AS stance", "total"),
        "desc_aggressiveness": _distribution("aggressiveness AS aggressiveness", "total"),
        "desc_topic": grouped("topic AS topic", {**_TOTAL, "pct": share(ROWS, everything), **_MEAN}),
        "desc_gender": _distribution("gender AS gender", "total"),
        "desc_geolocation": _distribution("geo AS has_coordinates", "tweets"),
        "desc_continent": _distribution("continent AS continent", "tweets", where="continent <> 'Unknown'"),
        "desc_sentiment_by_stance": f"SELECT f.*, {ratio('twice', 'CAST(20000000 AS HUGEINT)', 4)} AS"
        f" median_sentiment FROM ({figures}) f LEFT JOIN {middle} ON st = f.stance",
        "desc_sentiment_by_place": "SELECT CAST(la AS DOUBLE) AS lat, CAST(lo AS DOUBLE) AS lng, CAST(max(size) AS BIGINT) AS"
        f" scored_tweets, {ratio('CAST(sum(s7) AS HUGEINT) * 2 // count(*)', 'CAST(20000000 AS HUGEINT)', 4)} AS median_sentiment"
        " FROM (SELECT la, lo, s7, row_number() OVER (PARTITION BY la, lo ORDER BY s7) AS place, count(*) OVER (PARTITION BY la, lo)"
        " AS size FROM posts WHERE s7 IS NOT NULL) WHERE place IN ((size + 1) // 2, size // 2 + 1) GROUP BY la, lo",
    }


def _correlation(x: str, y: str) -> str:
    value = f"corr({x}, {y})"
    return f"CASE WHEN isnan({value}) THEN NULL ELSE round({value}, 4) + 0.0 END"


def _diagnostic_statements() -> dict[str, str]:
    s, t, hot = "CAST(s AS DOUBLE)", "CAST(t AS DOUBLE)", "CAST(hot AS INT)"
    return {
        "diag_divisive_topics": "SELECT topic, total_tweets, divisiveness_score, pct_aggressive, avg_sentiment,"
        f" sentiment_volatility, believers, deniers, pct_believers, pct_deniers FROM ({_TOPICS})",
        "diag_aggressive_topics": "SELECT topic, total_tweets, pct_aggressive, avg_sentiment, divisiveness_score"
        f" FROM ({_TOPICS})",
        "diag_aggressive_regions": "SELECT continent, total_tweets, pct_aggressive, divisiveness_score, avg_sentiment,"
        f" avg_temp_deviation FROM ({_REGIONS})",
        "diag_aggr_by_stance": grouped(
            "stance AS stance",
            {**_TOTAL, "aggressive": whole(HOT), **_HOT_SHARE, **_MEAN},
            where="stance <> 'Unknown'",
        ),
        "diag_aggr_by_gender": grouped(
            "gender AS gender", {**_TOTAL, **_HOT_SHARE, **_MEAN}, where="gender <> 'Unknown'"
        ),
        "diag_correlations": grouped(
            "",
            {
                "temp_vs_sentiment": _correlation(t, s),
                "temp_vs_aggression": _correlation(t, hot),
                "sentiment_vs_aggression": _correlation(s, hot),
                "sample_size": whole("count(*)"),
            },
            where="t IS NOT NULL AND s IS NOT NULL",
        ),
        "diag_hotspots": grouped(
            "continent AS continent; topic AS topic",
            {"tweets": whole("count(*)"), **_HOT_SHARE, **_MEAN},
            where=_NAMED,
            having=f"count(*) > {HOTSPOT_ABOVE}",
        )
        + " ORDER BY pct_aggressive DESC, continent, topic LIMIT 20",
        "diag_hotspots_default": grouped(
            "continent AS continent; topic AS topic",
            {"tweets": whole("count(*)"), **_HOT_SHARE, **_MEAN},
            source=f"(SELECT posts.* FROM posts, range({COPIES}))",
            where=_NAMED,
            having=f"count(*) > {HOTSPOT_DEFAULT}",
        )
        + " ORDER BY pct_aggressive DESC, continent, topic LIMIT 20",
        "diag_temp_by_year": grouped(
            "y AS tweet_year",
            {
                "avg_temp_deviation": mean("t7", 3),
                **_MEAN,
                "aggr_rate": ratio(HOT, ROWS, 4),
                "geotagged_tweets": whole("count(*)"),
            },
            where="t IS NOT NULL",
        ),
        "diag_stance_by_region": _REGION_STANCES,
        "diag_topic_top3": "SELECT tweet_year, topic, tweet_count, volume_rank, avg_sentiment, pct_aggressive"
        f" FROM ({_TOPIC_YEARS}) WHERE volume_rank < 4",
        "diag_seasonal": f"SELECT season, {whole('sum(total_tweets)')} AS tweets,"
        " "
        + ratio(
            "CAST(sum(CAST(round(avg_sentiment * 10000) AS HUGEINT) * total_tweets) AS HUGEINT)",
            "CAST(sum(total_tweets) AS HUGEINT) * 10000",
            4,
        )
        + " AS weighted_avg_sentiment,"
        f" {share('sum(aggressive_count)', 'CAST(sum(total_tweets) AS HUGEINT)')} AS pct_aggressive"
        f" FROM ({_MONTHS}) GROUP BY season",
        # Labels for before, in and after the event year.
        "diag_event_period": grouped(
            "['Pre-Paris (2006-2014)', 'Paris Agreement Year (2015)', 'Post-Paris (2016-2022)']"
            "[2 + CAST(coalesce(sign(y - 2015), 1) AS INT)] AS period",
            {
                "tweets": whole("count(*)"),
                **_MEAN,
                "pct_believers": share(BELIEVERS),
                **_HOT_SHARE,
            },
        ),
    }


# The order in which a query's rows come; a leading minus sign means descending. Missing values come last ascending and
# first descending.
ORDERS = {
    "audit_categories": "col -n val",
    "audit_created_at_format": "-occurrences sample_format",
    "audit_topic": "-occurrences topic_value",
    "clean_categories": "col -n val",
    "clean_year_distribution": "tweet_year",
    "desc_aggressiveness": "-total aggressiveness",
    "desc_continent": "-tweets continent",
    "desc_gender": "-total gender",
    "desc_sentiment_by_stance": "-tweets stance",
    "desc_sentiment_by_stance_bins": "-tweets stance",
    "desc_sentiment_by_place": "lat lng",
    "desc_sentiment_histogram": "sentiment_bucket",
    "desc_stance": "-total stance",
    "desc_topic": "-total_tweets topic",
    "desc_volume_by_year": "tweet_year",
    "diag_aggr_by_stance": "-pct_aggressive stance",
    "diag_aggressive_regions": "-pct_aggressive continent",
    "diag_aggressive_topics": "-pct_aggressive topic",
    "diag_divisive_topics": "-divisiveness_score topic",
    "diag_hotspots": "-pct_aggressive continent topic",
    "diag_hotspots_default": "-pct_aggressive continent topic",
    "diag_seasonal": "-pct_aggressive season",
    "diag_temp_by_year": "tweet_year",
    "diag_topic_top3": "tweet_year volume_rank topic",
    "diag_yearly_shift": "tweet_year",
    "diag_yoy_direction": "tweet_year",
    "mart_from_cells": "-aggression_rate topic",
    "raw_preview": "id",
    "vw_aggressiveness_analysis": "-aggressive_count tweet_year topic continent stance gender",
    "vw_executive_insights": "-aggression_rate topic",
    "vw_gender_analysis": "tweet_year gender",
    "vw_monthly_trends": "tweet_year tweet_month",
    "vw_regional_analysis": "-total_tweets continent",
    "vw_stance_by_region": "continent tweet_year",
    "vw_temp_sentiment": "tweet_year continent",
    "vw_topic_analysis": "-total_tweets topic",
    "vw_topic_yearly_trends": "tweet_year -tweet_count topic",
    "vw_yearly_trends": "tweet_year",
}


def ordered(name: str, text: str) -> str:
    """The statement with its rows in the query's order."""
    keys = ORDERS.get(name, "").split()
    listed = ", ".join(f"{key[1:]} DESC NULLS FIRST" if key[0] == "-" else f"{key} ASC NULLS LAST" for key in keys)
    return f"SELECT * FROM ({text}) AS unordered ORDER BY {listed}" if keys else text


def statements() -> dict[str, str]:
    return {name: ordered(name, text) for name, text in _statements().items()}


def _statements() -> dict[str, str]:
    on_posts = {
        **_validation_statements(),
        **_mart_statements(),
        **_descriptive_statements(),
        **_diagnostic_statements(),
    }
    found = {**_raw_statements(), **{name: f"{_CLEAN} {text}" for name, text in on_posts.items()}}
    found["mart_from_cells"] = found["vw_executive_insights"]
    found["vw_yearly_trends"] = _YEARLY
    found["diag_yearly_shift"] = (
        "SELECT tweet_year, total_tweets, avg_sentiment, yoy_sentiment_change, pct_believers, pct_deniers,"
        f" pct_aggressive FROM ({_YEARLY})"
    )
    found["diag_yoy_direction"] = (
        f"{_CLEAN}, {_change('true')} SELECT y AS tweet_year,"
        f" {ratio('total', '(n * 10000000)', 4)} AS avg_sentiment, {ratio('up', 'down', 4)} AS yoy_change,"
        " CASE coalesce(sign(up), 0) WHEN 1 THEN 'Improving' WHEN -1 THEN 'Declining' ELSE 'Stable' END AS direction"
        " FROM changes"
    )
    found["desc_sentiment_by_stance_bins"] = found["desc_sentiment_by_stance"]
    found["diag_correlations_cells"] = found["diag_correlations"]
    found["appended_correlations"] = found["diag_correlations"]
    found["clean_clustered"] = found["clean_tweets"]
    (south, north), (west, east), (first, last) = BOX
    found["clean_box"] = (
        f"SELECT * FROM ({found['clean_tweets']}) AS posts WHERE lat BETWEEN {south} AND {north}"
        f" AND lng BETWEEN {west} AND {east} AND tweet_year BETWEEN {first} AND {last}"
    )
    found["appended_duplicates"] = found["audit_duplicates"]
    counts = f"{whole('count(*)')} AS total_rows, {whole('count(DISTINCT id)')} AS distinct_ids, {whole('count(*) - count(DISTINCT id)')} AS duplicate_rows"
    found["distinct_ids_of_loads"] = (
        f"{_RAW}, {_SPOILT}, signed AS (SELECT topic, CASE WHEN id % 5 = 0 THEN -id ELSE id END AS id FROM spoilt),"
        " loads AS (SELECT * FROM signed WHERE id IS NULL OR id % 3 <> 0 UNION ALL SELECT * FROM signed WHERE id % 2 = 0)"
        f" SELECT topic, {counts} FROM loads GROUP BY topic UNION ALL SELECT '(all)' AS topic, {counts} FROM loads"
    )
    for name in ("clean_tweets", "vw_yearly_trends", "vw_monthly_trends", "vw_topic_analysis", "vw_gender_analysis"):
        found[f"appended_{name}"] = found[name]
    for name in [name for name in found if name.startswith("vw_")]:
        found[f"published_{name}"] = found[name]
    return found
