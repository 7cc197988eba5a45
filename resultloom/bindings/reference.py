"""Reference SQL (DuckDB dialect) for the bound queries, built from named parts.

Each part is a common table expression with the parts it reads; ``sql`` puts the
needed ones, in the order written here, before a final SELECT.
"""

from __future__ import annotations

from resultloom.bindings.fixed import CURVES, PUBLISHERS, SOURCE_QUALITY, STOPWORDS, TRACKING_KEYS, WEIGHT_SETS, Curve
from resultloom.plans.bm25 import VARIANTS, Variant
from resultloom.plans.evaluation import FILTER_CONFIGS, RANKING_CANDIDATES

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')"


def content_tokens(text: str) -> str:
    return f"list_filter({tokens(text)}, lambda w: NOT list_contains([{quoted(STOPWORDS)}], w))"


def norm_title(title: str) -> str:
    suffix = rf"(\s*[-|—–]\s*({'|'.join(PUBLISHERS)}))+$"
    bare = f"regexp_replace(lower(trim({title})), '{suffix}', '')"
    words = rf"regexp_replace({bare}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return rf"trim(regexp_replace({words}, '\s+', ' ', 'g'))"


def canonical_url(url: str) -> str:
    """For http(s) URLs as the tables hold them: no user info, no escapes."""
    low = f"regexp_replace({url}, '#.*', '')"
    scheme = f"lower(regexp_extract({low}, '^([A-Za-z]+)://', 1))"
    site = f"lower(regexp_extract({low}, '^[A-Za-z]+://([^/?]+)', 1))"
    host = (
        f"CASE WHEN {scheme} = 'https' THEN regexp_replace({site}, ':443$', '')"
        f" ELSE regexp_replace({site}, ':80$', '') END"
    )
    path = f"regexp_replace(regexp_extract({low}, '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/+', '/', 'g')"
    shown = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END"
    query = f"regexp_extract({low}, '[?](.*)$', 1)"
    kept = (
        f"list_sort(list_filter(string_split({query}, '&'), lambda p: regexp_matches(p, '^[^=]*=.')"
        f" AND NOT list_contains([{quoted(TRACKING_KEYS)}], lower(split_part(p, '=', 1)))))"
    )
    return (
        f"{scheme} || '://' || {host} || {shown} ||"
        f" CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    )


def type_order(column: str, wide: bool = False) -> str:
    video = " WHEN 'video' THEN 3" if wide else ""
    return f"CASE {column} WHEN 'news' THEN 0 WHEN 'social' THEN 1 WHEN 'reference' THEN 2{video} ELSE 9 END"


def age_hours(ts: str = "published_at") -> str:
    return f"greatest(0.0::DOUBLE, (epoch_us({NOW}) - epoch_us({ts}))::DOUBLE / 1e6::DOUBLE / 3600.0::DOUBLE)"


def freshness(decay: Curve = Curve(), ts: str = "published_at", kind: str = "source_type") -> str:
    age, floor, span = age_hours(ts), f"{decay.floor}::DOUBLE", f"(1.0::DOUBLE - {decay.floor}::DOUBLE)"
    if decay.shape == "exp":
        half = f"CASE WHEN {kind} = 'news' THEN {decay.news_half_life}::DOUBLE ELSE {decay.social_half_life}::DOUBLE END"
        value = f"{floor} + {span} * pow(2.0::DOUBLE, -({age}) / ({half}))"
    elif decay.shape == "linear30d":
        value = f"greatest({floor}, 1.0::DOUBLE - ({age} / 720.0::DOUBLE) * {span})"
    elif decay.shape == "step":
        value = f"CASE WHEN {age} < 24 THEN 1.0 WHEN {age} < 168 THEN 0.7 WHEN {age} < 720 THEN 0.4 ELSE 0.2 END::DOUBLE"
    else:
        value = "1.0::DOUBLE"
    return (
        f"CASE WHEN {kind} = 'reference' THEN {decay.reference}::DOUBLE"
        f" WHEN {ts} IS NULL THEN {decay.missing}::DOUBLE ELSE {value} END"
    )


def table_curve(key: int | None) -> str:
    """Scores by a curve of the nation table, or by the one that is a function."""
    if key is None:
        return f"SELECT 'own' AS curve, source_type, CASE WHEN published_at IS NULL THEN 0.0 ELSE 1 / (1 + {age_hours('published_at')}) END AS fresh FROM results"
    shape = ("exp", "linear30d", "step", "constant")[key % 4]
    region = f"(SELECT n_regionkey FROM nation WHERE n_nationkey = {key}) / 16"
    own = Curve(shape=shape, news_half_life=6.0 + key, social_half_life=3.0 + key, reference=0.75, missing=0.25, floor=region)
    return f"SELECT 'n{key}' AS curve, source_type, {freshness(own)} AS fresh FROM results"


def quality() -> str:
    named = " ".join(f"WHEN source_name = '{n}' THEN {v}::DOUBLE" for n, v in SOURCE_QUALITY.items())
    return f"CASE {named} WHEN source_type = 'reference' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END"


def weighted(weights: dict, kind: str = "scored_type") -> str:
    def total(w):
        return f"{w[0]}::DOUBLE * relevance + {w[1]}::DOUBLE * freshness + {w[2]}::DOUBLE * quality"

    cases = " ".join(f"WHEN '{k}' THEN {total(w)}" for k, w in weights.items() if k != "news")
    return f"CASE {kind} {cases} ELSE {total(weights['news'])} END"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by the textbook table, a row per character of ``a``."""
    return (
        f"list_reduce(string_split({a}, ''), lambda line, ch: list_reduce(range(1, length({b})::INT + 1),"
        f" lambda nl, j: list_append(nl, CASE WHEN substr({b}, j::INT, 1) = ch THEN line[j] + 1"
        f" ELSE greatest(line[j + 1], nl[-1]) END), [0]),"
        f" list_transform(range(0, length({b})::INT + 1), lambda z: 0))[-1]"
    )


NEWEST = "published_at DESC NULLS LAST, url, id"

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], body: str) -> None:
    PARTS[name] = (needs, body)


def sql(select: str, *needs: str) -> str:
    wanted: set[str] = set()

    def want(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for below in PARTS[name][0]:
                want(below)

    for name in needs:
        want(name)
    parts = [f"{n} AS ({PARTS[n][1]})" for n in PARTS if n in wanted]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select


part("nq", (), "SELECT count(*) AS n FROM benchmark")
part(
    "results",
    ("nq",),
    f"""SELECT 's' || (doc_id % n) AS search_id, CAST(doc_id AS VARCHAR) AS id,
    CASE doc_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'social' ELSE 'reference' END AS source_type,
    CASE source WHEN 'src0' THEN 'The Guardian' WHEN 'src1' THEN 'Wikipedia' WHEN 'src2' THEN 'Global Wire' ELSE source END AS source_name,
    split_part(text, chr(10), 1) AS title,
    nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), '') AS description,
    'https://n.example/' || lang || '/' || (doc_id // (2 * n)) || CASE WHEN (doc_id // n) % 2 = 1 THEN '?utm_source=x' ELSE '' END AS url,
    CASE WHEN doc_id % 5 = 0 THEN '[deleted]' ELSE 'author' || (doc_id % 17) END AS author,
    CASE WHEN doc_id % 7 <> 0 THEN {NOW} - to_hours((n_chars % 2000)::INT) END AS published_at,
    {NOW} - to_seconds(doc_id % 600) AS retrieved_at,
    CASE WHEN doc_id % 11 <> 0 THEN lang END AS language, doc_id
    FROM documents, nq""",
)
part(
    "variants",
    ("results",),
    """SELECT search_id, id || tag AS id, source_type, source_name, t AS title, description,
    url || CASE WHEN tag <> '' THEN '/' || id || tag ELSE '' END AS url,
    published_at + to_days(days) AS published_at
    FROM (SELECT *, '' AS tag, title AS t, 0 AS days FROM results
      UNION ALL SELECT *, 'b', title || ' — The Guardian', 1 FROM results
      UNION ALL SELECT *, 'c', array_to_string(list_concat(list_concat(string_split(title, ' ')[2:], [string_split(title, ' ')[1]]), ['again']), ' '), 30 FROM results)""",
)
part(
    "searches",
    (),
    f"""SELECT 's' || item_id AS search_id, text AS query,
    {NOW} - to_days(1) + to_seconds(item_id * 60) AS created_at,
    CASE WHEN item_id % 5 <> 0 THEN {NOW} - to_days(1) + to_seconds(item_id * 60 + item_id % 9) END AS completed_at,
    CASE WHEN item_id % 5 = 0 THEN 'running' ELSE 'completed' END AS status FROM benchmark""",
)
part(
    "grades",
    ("results",),
    """SELECT r.search_id, r.id, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS rel
    FROM results r LEFT JOIN labels l ON r.doc_id = l.doc_id""",
)
part(
    "source_events",
    (),
    """SELECT CAST(user_id AS VARCHAR) AS search_id, event_type AS source_name, ts AS created_at, event_id,
    CASE event_id % 10 WHEN 7 THEN 'failed' WHEN 8 THEN 'timeout' WHEN 9 THEN 'rate_limited' ELSE 'success' END AS status,
    CAST(floor(value * 100) AS BIGINT) AS latency_ms, event_id % 13 AS result_count FROM events""",
)
part(
    "gold",
    ("results",),
    f"SELECT search_id, id, search_id || '|' || array_to_string({tokens('title')}, ' ') AS gold FROM results",
)
part(
    "unclear",
    ("nq",),
    "SELECT CAST(doc_id AS VARCHAR) AS a, CAST(doc_id + n AS VARCHAR) AS b FROM labels, nq WHERE toxic = 1",
)
# --- linking ---------------------------------------------------------------
part(
    "keyed",
    ("results",),
    f"SELECT *, {canonical_url('url')} AS canonical_url, {norm_title('title')} AS norm_title FROM results",
)
part(
    "variant_keyed",
    ("variants",),
    f"SELECT *, {canonical_url('url')} AS canonical_url, {norm_title('title')} AS norm_title FROM variants",
)


def word_parts(prefix: str, source: str) -> None:
    """Word sets, their matches, and pairs of rows that match fuzzily."""
    part(
        f"{prefix}spoken",
        (source,),
        f"""SELECT *, list_sort(list_distinct(string_split(norm_title, ' '))) AS words FROM {source}
        WHERE source_type IN ('news', 'social') AND len(string_split(norm_title, ' ')) >= 3""",
    )
    part(
        f"{prefix}sets",
        (f"{prefix}spoken",),
        f"SELECT DISTINCT search_id, source_type, words, array_to_string(words, ' ') AS joined FROM {prefix}spoken",
    )
    part(
        f"{prefix}rests",
        (f"{prefix}sets",),
        f"""SELECT *, length(shared) AS li, length(rest_a) AS l1, length(rest_b) AS l2,
        CASE WHEN length(shared) > 0 THEN 1 ELSE 0 END AS g FROM (
        SELECT a.search_id, a.source_type, a.joined AS joined_a, b.joined AS joined_b,
        array_to_string(list_filter(a.words, lambda w: list_contains(b.words, w)), ' ') AS shared,
        array_to_string(list_filter(a.words, lambda w: NOT list_contains(b.words, w)), ' ') AS rest_a,
        array_to_string(list_filter(b.words, lambda w: NOT list_contains(a.words, w)), ' ') AS rest_b
        FROM {prefix}sets a JOIN {prefix}sets b ON a.search_id = b.search_id AND a.source_type = b.source_type AND a.joined < b.joined)""",
    )
    part(
        f"{prefix}ratios",
        (f"{prefix}rests",),
        f"""SELECT *, CASE WHEN li > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (g + l1) / (2 * li + g + l1) ELSE 0 END AS r1,
        CASE WHEN li > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (g + l2) / (2 * li + g + l2) ELSE 0 END AS r2,
        li > 0 AND (l1 = 0 OR l2 = 0) AS inside, 2 * (li + g) + l1 + l2 AS total FROM {prefix}rests""",
    )
    part(
        f"{prefix}compared",
        (f"{prefix}ratios",),
        f"""SELECT *, {lcs('rest_a', 'rest_b')} AS common FROM {prefix}ratios
        WHERE NOT inside AND (r1 >= 90 OR r2 >= 90 OR 100.0::DOUBLE - 100.0::DOUBLE * abs(l1 - l2) / total >= 90)""",
    )
    part(
        f"{prefix}matches",
        (f"{prefix}compared",),
        f"""SELECT search_id, source_type, joined_a, joined_b, 100.0::DOUBLE AS score FROM {prefix}ratios WHERE inside
        UNION ALL SELECT search_id, source_type, joined_a, joined_b, greatest(r1, r2, 100.0::DOUBLE - 100.0::DOUBLE * (l1 + l2 - 2 * common) / total)
        FROM {prefix}compared WHERE greatest(r1, r2, 100.0::DOUBLE - 100.0::DOUBLE * (l1 + l2 - 2 * common) / total) >= 90""",
    )
    part(
        f"{prefix}fuzzy",
        (f"{prefix}matches", f"{prefix}spoken"),
        f"""SELECT a.search_id, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, 'fuzzy_title' AS method
        FROM {prefix}matches m
        JOIN {prefix}spoken a ON a.search_id = m.search_id AND a.source_type = m.source_type AND array_to_string(a.words, ' ') = m.joined_a
        JOIN {prefix}spoken b ON b.search_id = m.search_id AND b.source_type = m.source_type AND array_to_string(b.words, ' ') = m.joined_b
        WHERE a.published_at IS NULL OR b.published_at IS NULL OR abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 604800000000
        UNION ALL SELECT a.search_id, a.id, b.id, 'fuzzy_title' FROM {prefix}spoken a
        JOIN {prefix}spoken b ON a.search_id = b.search_id AND a.source_type = b.source_type AND a.words = b.words AND a.id < b.id
        WHERE a.published_at IS NULL OR b.published_at IS NULL OR abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 604800000000""",
    )


word_parts("", "keyed")
word_parts("v_", "variant_keyed")
part(
    "exact_pairs",
    ("keyed",),
    """SELECT a.search_id, a.id AS a, b.id AS b, 'canonical_url' AS method FROM keyed a
    JOIN keyed b ON a.search_id = b.search_id AND a.canonical_url = b.canonical_url AND a.id < b.id
    UNION ALL SELECT a.search_id, a.id, b.id, 'normalized_title' FROM keyed a
    JOIN keyed b ON a.search_id = b.search_id AND a.source_type = b.source_type AND a.norm_title = b.norm_title AND a.id < b.id
    WHERE a.norm_title <> ''""",
)
part("all_pairs", ("exact_pairs", "fuzzy"), "SELECT * FROM exact_pairs UNION ALL SELECT * FROM fuzzy")


def closure_parts(prefix: str, pairs: str, rows: str) -> None:
    part(
        f"{prefix}both",
        (pairs,),
        f"SELECT DISTINCT search_id, a, b FROM {pairs} UNION SELECT DISTINCT search_id, b, a FROM {pairs}",
    )
    part(
        f"{prefix}reach",
        (f"{prefix}both",),
        f"SELECT search_id, a AS id, a AS other FROM {prefix}both UNION SELECT r.search_id, r.id, e.b FROM {prefix}reach r JOIN {prefix}both e ON e.search_id = r.search_id AND e.a = r.other",
    )
    part(
        f"{prefix}member",
        (f"{prefix}reach",),
        f"SELECT search_id, id, min(other) AS component FROM {prefix}reach GROUP BY ALL",
    )
    part(
        f"{prefix}groups",
        (f"{prefix}member", pairs, rows),
        f"""SELECT m.search_id, m.component AS first_member, count(*) AS member_count,
        arg_min(m.id, (CASE WHEN published_at IS NULL THEN 1 ELSE 0 END, {type_order('source_type')}, -length(coalesce(description, '')), url, m.id)) AS canonical_id,
        (SELECT array_to_string(list_sort(list(DISTINCT method)), ',') FROM {pairs} p WHERE p.search_id = m.search_id AND p.a IN (SELECT x.id FROM {prefix}member x WHERE x.search_id = m.search_id AND x.component = m.component)) AS methods
        FROM {prefix}member m JOIN {rows} r ON r.search_id = m.search_id AND r.id = m.id GROUP BY m.search_id, m.component""",
    )


closure_parts("exact_", "exact_pairs", "keyed")
closure_parts("fuzzy_", "v_fuzzy", "variant_keyed")
closure_parts("near_", "fuzzy", "keyed")
closure_parts("all_", "all_pairs", "keyed")
part(
    "annotated",
    ("keyed", "all_member", "all_groups"),
    """SELECT k.*, g.first_member AS grp, coalesce(k.id <> g.canonical_id, false) AS is_duplicate FROM keyed k
    LEFT JOIN all_member m ON m.search_id = k.search_id AND m.id = k.id
    LEFT JOIN all_groups g ON g.search_id = m.search_id AND g.first_member = m.component""",
)
# --- ranking ---------------------------------------------------------------
part(
    "overlap",
    ("results", "searches"),
    f"""SELECT *, 3 * len(list_filter(qt, lambda w: list_contains(tt, w))) + len(list_filter(qt, lambda w: list_contains(dt, w))) AS raw_relevance
    FROM (SELECT r.*, list_distinct({tokens('query')}) AS qt, list_distinct({tokens('title')}) AS tt, list_distinct({tokens('description')}) AS dt
      FROM results r JOIN searches s ON r.search_id = s.search_id)""",
)
part(
    "components",
    ("overlap",),
    f"""SELECT * EXCLUDE (qt, tt, dt), source_type AS scored_type,
    CASE WHEN max(raw_relevance) OVER w = 0 THEN 0.0 ELSE raw_relevance::DOUBLE / max(raw_relevance) OVER w END AS relevance,
    {freshness()} AS freshness, {quality()} AS quality FROM overlap WINDOW w AS (PARTITION BY search_id)""",
)
part(
    "inherited",
    ("components", "annotated"),
    """SELECT c.* EXCLUDE (relevance, freshness, quality, scored_type), a.grp, a.is_duplicate,
    coalesce(k.relevance, c.relevance) AS relevance, coalesce(k.freshness, c.freshness) AS freshness,
    coalesce(k.quality, c.quality) AS quality, coalesce(k.source_type, c.source_type) AS scored_type
    FROM components c JOIN annotated a ON a.search_id = c.search_id AND a.id = c.id
    LEFT JOIN (SELECT x.search_id, x.grp, y.relevance, y.freshness, y.quality, y.source_type FROM annotated x
      JOIN components y ON x.search_id = y.search_id AND x.id = y.id WHERE x.grp IS NOT NULL AND NOT x.is_duplicate) k
    ON k.search_id = a.search_id AND k.grp = a.grp""",
)


def band_parts(prefix: str, scored: str, keys: str) -> None:
    part(
        f"{prefix}anchors",
        (scored,),
        f"""SELECT {keys}, list_reduce(list_sort(list(DISTINCT rank_score), 'DESC'), lambda acc, s:
        CASE WHEN len(acc) = 0 OR acc[-1] - s > 0.05::DOUBLE THEN list_append(acc, s) ELSE acc END, []::DOUBLE[]) AS anchors
        FROM {scored} GROUP BY {keys}""",
    )
    part(
        f"{prefix}banded",
        (f"{prefix}anchors", scored),
        f"SELECT s.*, len(list_filter(anchors, lambda a: a >= rank_score)) - 1 AS band FROM {scored} s JOIN {prefix}anchors USING ({keys})",
    )
    part(
        f"{prefix}turned",
        (f"{prefix}banded",),
        f"""SELECT *, row_number() OVER (PARTITION BY {keys}, band, {type_order('source_type')} ORDER BY {NEWEST}) AS turn FROM {prefix}banded""",
    )
    part(
        f"{prefix}placed",
        (f"{prefix}turned",),
        f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY band, turn, {type_order('source_type')}) - 1 AS rank_position FROM {prefix}turned""",
    )


part("scored", ("inherited",), f"SELECT *, {weighted(WEIGHT_SETS['design'])} AS rank_score FROM inherited")
band_parts("", "scored", "search_id")
part(
    "wide",
    ("components",),
    " UNION ALL ".join(
        f"SELECT *, '{name}' AS candidate, {'true' if diverse else 'false'} AS diverse, {weighted(WEIGHT_SETS[w])} AS rank_score FROM components"
        for name, (w, diverse) in RANKING_CANDIDATES.items()
    ),
)
part("wide_diverse", ("wide",), "SELECT * FROM wide WHERE diverse")
band_parts("wide_", "wide_diverse", "candidate, search_id")
part(
    "candidates",
    ("wide", "wide_placed"),
    f"""SELECT candidate, search_id, id, freshness, rank_position + 1 AS position FROM wide_placed
    UNION ALL SELECT candidate, search_id, id, freshness, row_number() OVER (PARTITION BY candidate, search_id
      ORDER BY rank_score DESC, {type_order('source_type')}, {NEWEST}) FROM wide WHERE NOT diverse""",
)
part(
    "lexical",
    ("overlap",),
    f"""SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY raw_relevance DESC, {type_order('source_type', True)}, title, id) AS position FROM overlap""",
)
# --- metrics ---------------------------------------------------------------
part(
    "ideal",
    ("grades",),
    """SELECT search_id, sum(CASE WHEN p <= 10 THEN (pow(2, rel) - 1) / log2(p + 1) ELSE 0 END) AS idcg FROM
    (SELECT search_id, rel, row_number() OVER (PARTITION BY search_id ORDER BY rel DESC) AS p FROM grades) GROUP BY search_id""",
)


def metrics(ranked: str, keys: str, extra: str = "") -> str:
    """Per-group metrics of a part with position, joined to grades."""
    return f"""SELECT m.*, CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END AS ndcg_at_10 FROM (
    SELECT {keys}, count(*) FILTER (position <= 5 AND rel >= 1) / 5.0::DOUBLE AS precision_at_5,
    count(*) FILTER (position <= 10 AND rel >= 1) / 10.0::DOUBLE AS precision_at_10,
    coalesce(1.0::DOUBLE / min(position) FILTER (rel >= 1), 0) AS reciprocal_rank,
    sum(CASE WHEN position <= 10 THEN (pow(2, rel) - 1) / log2(position + 1) ELSE 0 END) AS dcg{extra}
    FROM (SELECT x.*, g.rel FROM {ranked} x JOIN grades g USING (search_id, id)) GROUP BY {keys}) m JOIN ideal USING (search_id)"""


MEANS = (
    "round(avg(precision_at_5), 6) AS precision_at_5, round(avg(precision_at_10), 6) AS precision_at_10,"
    " round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(ndcg_at_10), 6) AS ndcg_at_10"
)
JUNK = (
    ", count(*) FILTER (position <= 10 AND rel = 0) AS rel0_in_top10,"
    " count(*) FILTER (position <= 10 AND rel = 0 AND freshness >= 0.7) AS fresh_junk_in_top10"
)
part("lexical_metrics", ("lexical", "grades", "ideal"), metrics("lexical", "search_id"))
part(
    "table_wide",
    ("components",),
    """SELECT c.*, 't' || r_regionkey AS candidate, r_regionkey % 2 = 0 AS diverse,
    0.75::DOUBLE * relevance * (1 - r_regionkey / 4 + r_regionkey / 4 * freshness) + r_regionkey / 16 * quality AS rank_score FROM components c, region""",
)
part("table_diverse", ("table_wide",), "SELECT * FROM table_wide WHERE diverse")
band_parts("table_", "table_diverse", "candidate, search_id")
part(
    "table_candidates",
    ("table_wide", "table_placed"),
    f"""SELECT candidate, search_id, id, freshness, rank_position + 1 AS position FROM table_placed
    UNION ALL SELECT candidate, search_id, id, freshness, row_number() OVER (PARTITION BY candidate, search_id
      ORDER BY rank_score DESC, {type_order('source_type')}, {NEWEST}) FROM table_wide WHERE NOT diverse""",
)
part("table_metrics", ("table_candidates", "grades", "ideal"), metrics("table_candidates", "candidate, search_id", JUNK))
part("candidate_metrics", ("candidates", "grades", "ideal"), metrics("candidates", "candidate, search_id", JUNK))


def passes(config: dict) -> str:
    tests = ["true"]
    if "source_types" in config:
        tests.append(f"source_type IN ({quoted(config['source_types'])})")
    if "language" in config:
        tests.append(f"language = '{config['language']}'")
    if config.get("canonical"):
        tests.append("NOT is_duplicate")
    if "hours" in config:
        tests.append(
            f"(source_type = 'reference' OR published_at >= {NOW} - INTERVAL {config['hours']} HOURS)"
        )
    return " AND ".join(tests)


part(
    "views",
    ("placed",),
    " UNION ALL ".join(
        f"SELECT '{n}' AS view, search_id, id, freshness, row_number() OVER (PARTITION BY search_id ORDER BY rank_position) AS position FROM placed WHERE {passes(c)}"
        for n, c in FILTER_CONFIGS.items()
    ),
)
part(
    "view_metrics",
    ("views", "grades", "ideal"),
    metrics(
        "views",
        "view, search_id",
        ", count(*) AS kept, count(*) FILTER (rel >= 1) AS kept1, count(*) FILTER (rel >= 2) AS kept2" + JUNK,
    ),
)
part(
    "curves",
    ("results", "grades"),
    " UNION ALL ".join(
        f"SELECT '{n}' AS curve, search_id, id, source_type, rel, {freshness(d)} AS fresh FROM results JOIN grades USING (search_id, id)"
        for n, d in CURVES.items()
    ),
)
# --- BM25 ------------------------------------------------------------------
part(
    "bag",
    ("results", "searches"),
    f"""SELECT r.*, query, {content_tokens('query')} AS terms, {content_tokens('title')} AS tw, {content_tokens('description')} AS dw
    FROM results r JOIN searches s USING (search_id)""",
)
part(
    "bag_stats",
    ("bag",),
    "SELECT search_id, count(*) AS documents, avg(len(tw)) AS title_mean, avg(len(dw)) AS description_mean FROM bag GROUP BY search_id",
)
part(
    "held_all",
    ("bag",),
    """SELECT search_id, f, term, count(*) AS n FROM (
    SELECT search_id, 't' AS f, unnest(list_distinct(tw)) AS term FROM bag UNION ALL SELECT search_id, 'd', unnest(list_distinct(dw)) FROM bag)
    GROUP BY ALL""",
)
# Of the words a search asks for only: what the term statistics need.
part(
    "held",
    ("bag",),
    """SELECT search_id, f, term, count(*) AS n FROM (
    SELECT search_id, 't' AS f, unnest(list_distinct(list_filter(tw, lambda w: list_contains(terms, w)))) AS term FROM bag
    UNION ALL SELECT search_id, 'd', unnest(list_distinct(list_filter(dw, lambda w: list_contains(terms, w)))) FROM bag)
    GROUP BY ALL""",
)
part(
    "asked",
    ("searches",),
    f"SELECT search_id, generate_subscripts(terms, 1) AS spot, unnest(terms) AS term, len(terms) AS asked, terms FROM (SELECT search_id, {content_tokens('query')} AS terms FROM searches)",
)
part(
    "asked_stats",
    ("asked", "held", "bag_stats"),
    """SELECT a.*, documents, title_mean, description_mean, coalesce(t.n, 0) AS tn, coalesce(d.n, 0) AS dn,
    len(list_filter(terms, lambda w: w = a.term)) AS qtf FROM asked a JOIN bag_stats USING (search_id)
    LEFT JOIN held t ON t.search_id = a.search_id AND t.f = 't' AND t.term = a.term
    LEFT JOIN held d ON d.search_id = a.search_id AND d.f = 'd' AND d.term = a.term""",
)


def idf(mode: str, n: str) -> str:
    return {
        "smooth1": f"ln(1 + (documents - {n} + 0.5::DOUBLE) / ({n} + 0.5::DOUBLE))",
        "smooth2": f"ln(1 + (documents - {n})::DOUBLE / ({n} + 1))",
        "plain": f"ln(1 + documents::DOUBLE / ({n} + 1))",
        "classic": f"CASE WHEN documents - {n} + 0.5 > 0 THEN greatest(0.0::DOUBLE, ln((documents - {n} + 0.5::DOUBLE) / ({n} + 0.5::DOUBLE))) ELSE 0.0 END",
    }[mode]


def saturated(tf: str, n: str, length: str, mean: str, v: Variant) -> str:
    norm = f"CASE WHEN {mean} > 0 THEN 1 - {v.b}::DOUBLE + {v.b}::DOUBLE * ({length} / {mean}) ELSE 1.0::DOUBLE END"
    return f"CASE WHEN {tf} > 0 THEN {idf(v.idf, n)} * ({tf} * 2.5::DOUBLE) / ({tf} + 1.5::DOUBLE * ({norm})) ELSE 0.0 END"


part(
    "term_hits",
    ("bag", "asked_stats"),
    """SELECT b.search_id, b.id, spot, documents, title_mean, description_mean, tn, dn, len(tw) AS tl, len(dw) AS dl,
    len(list_filter(tw, lambda w: w = a.term)) AS ttf, len(list_filter(dw, lambda w: w = a.term)) AS dtf
    FROM bag b JOIN asked_stats a USING (search_id)""",
)


def bm25_parts(name: str, v: Variant) -> None:
    part(
        f"ceiling_{name}",
        ("asked_stats",),
        f"""SELECT search_id, {v.title}::DOUBLE * sum({saturated('qtf', 'tn', 'asked', 'title_mean', v)} ORDER BY spot)
        + {v.description}::DOUBLE * sum({saturated('qtf', 'dn', 'asked', 'description_mean', v)} ORDER BY spot) AS ceiling FROM asked_stats GROUP BY search_id""",
    )
    part(
        f"base_{name}",
        ("term_hits", f"ceiling_{name}"),
        f"""SELECT search_id, id, CASE WHEN any_value(ceiling) > 0 THEN ({v.title}::DOUBLE * sum({saturated('ttf', 'tn', 'tl', 'title_mean', v)} ORDER BY spot)
        + {v.description}::DOUBLE * sum({saturated('dtf', 'dn', 'dl', 'description_mean', v)} ORDER BY spot)) / any_value(ceiling) ELSE 0.0 END AS base_relevance
        FROM term_hits JOIN ceiling_{name} USING (search_id) GROUP BY search_id, id""",
    )


for _name, _variant in VARIANTS.items():
    bm25_parts(_name.replace(".", "_"), _variant)
BM25_ORDER = f"{type_order('source_type', True)}, published_at DESC NULLS LAST, url, id"
part(
    "bm25_core",
    ("results", "base_core"),
    f"SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY bm25 DESC, {BM25_ORDER}) AS position FROM (SELECT r.*, least(1.0, base_relevance) AS bm25 FROM results r JOIN base_core USING (search_id, id))",
)
part(
    "bonus",
    ("bag",),
    """SELECT search_id, id,
    CASE WHEN len(terms) > 0 AND contains(' ' || array_to_string(tw, ' ') || ' ', ' ' || array_to_string(terms, ' ') || ' ') THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_phrase_title,
    CASE WHEN contains(lower(title), trim(lower(query))) THEN 0.75 ELSE 0.0 END::DOUBLE AS query_substring_title,
    CASE WHEN contains(lower(coalesce(description, '')), trim(lower(query))) THEN 0.35 ELSE 0.0 END::DOUBLE AS query_substring_description,
    CASE WHEN len(terms) > 0 AND len(list_filter(terms, lambda t: NOT list_contains(tw, t))) = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS all_terms_title FROM bag""",
)
part(
    "bm25_full",
    ("results", "base_core", "bonus"),
    f"""SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY bm25 DESC, {BM25_ORDER}) AS position FROM (
    SELECT r.*, least(1.0, base_relevance + exact_phrase_title + query_substring_title + query_substring_description + all_terms_title) AS bm25
    FROM results r JOIN base_core USING (search_id, id) JOIN bonus USING (search_id, id))""",
)
part(
    "variant_ranks",
    tuple(f"base_{n.replace('.', '_')}" for n in VARIANTS) + ("results",),
    " UNION ALL ".join(
        f"SELECT '{n}' AS variant, search_id, id, row_number() OVER (PARTITION BY search_id ORDER BY base_relevance DESC, {BM25_ORDER}) AS position FROM results JOIN base_{n.replace('.', '_')} USING (search_id, id)"
        for n in VARIANTS
    ),
)
for _key in range(5):
    bm25_parts(f"v{_key}", Variant(title=1 + _key / 2, description=1 - _key / 8, b=_key / 4, idf="smooth2" if _key % 2 else "plain"))
part(
    "table_variant_ranks",
    tuple(f"base_v{n}" for n in range(5)) + ("results",),
    " UNION ALL ".join(
        f"SELECT 'v{n}' AS variant, search_id, id, row_number() OVER (PARTITION BY search_id ORDER BY base_relevance DESC, {BM25_ORDER}) AS position FROM results JOIN base_v{n} USING (search_id, id)"
        for n in range(5)
    ),
)
part("table_variant_metrics", ("table_variant_ranks", "grades", "ideal"), metrics("table_variant_ranks", "variant, search_id"))
part("variant_metrics", ("variant_ranks", "grades", "ideal"), metrics("variant_ranks", "variant, search_id"))
part(
    "three_ranks",
    ("lexical", "bm25_core", "bm25_full"),
    """SELECT 'baseline' AS ranker, search_id, id, position FROM lexical UNION ALL SELECT 'bm25_core', search_id, id, position FROM bm25_core
    UNION ALL SELECT 'bm25_full', search_id, id, position FROM bm25_full""",
)
part("three_metrics", ("three_ranks", "grades", "ideal"), metrics("three_ranks", "ranker, search_id"))
part(
    "two_ranks",
    ("lexical", "bm25_core", "grades"),
    """SELECT l.search_id, l.id, l.title, l.raw_relevance, l.position AS lexical_at, b.bm25, b.position AS bm25_at, g.rel
    FROM lexical l JOIN bm25_core b USING (search_id, id) JOIN grades g USING (search_id, id)""",
)
# --- pairs and operations --------------------------------------------------
part(
    "gold_pairs",
    ("gold",),
    "SELECT a.search_id, a.id AS a, b.id AS b FROM gold a JOIN gold b ON a.gold = b.gold AND a.id < b.id",
)
part(
    "found_pairs",
    ("all_member",),
    "SELECT a.search_id, a.id AS a, b.id AS b FROM all_member a JOIN all_member b ON a.search_id = b.search_id AND a.component = b.component AND a.id < b.id",
)
part(
    "bridge_pairs",
    ("exact_member", "near_member"),
    """SELECT a.search_id, a.id AS a, b.id AS b FROM exact_member a JOIN exact_member b ON a.search_id = b.search_id AND a.component = b.component AND a.id < b.id
    UNION SELECT a.search_id, a.id, b.id FROM near_member a JOIN near_member b ON a.search_id = b.search_id AND a.component = b.component AND a.id < b.id""",
)
part("unclear_pairs", ("unclear",), "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM unclear")
part(
    "pages_read",
    (),
    """SELECT page_id, CAST(spelling AS BIGINT) AS spelling, u AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS language FROM (
    SELECT *, 0 AS spelling, url AS u FROM pages
    UNION ALL SELECT *, 1, regexp_replace(url, '#.*', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=mail&gclid=1' FROM pages
    UNION ALL SELECT *, 2, regexp_replace(url, '#.*', '') || '#x' FROM pages
    UNION ALL SELECT *, 3, replace(url, regexp_extract(url, '^https?://([^/?#]+)', 1), upper(regexp_extract(url, '^https?://([^/?#]+)', 1))) FROM pages
    UNION ALL SELECT *, 4, replace(url, regexp_extract(url, '^https?://([^/?#]+)', 1), regexp_extract(url, '^https?://([^/?#]+)', 1) || CASE WHEN url LIKE 'https%' THEN ':443' ELSE ':80' END) FROM pages)""",
)
part(
    "fetches",
    ("results", "nq"),
    f"""SELECT search_id, page, source, n_rows, titled, CAST(epoch({NOW}) AS BIGINT) + page AS fetched,
    (CAST(epoch({NOW}) AS BIGINT) + page + length(source) + CAST(substr(search_id, 2) AS BIGINT)) % 7 AS h FROM (
    SELECT search_id, doc_id // (10 * n) AS page, count(*) AS n_rows, count(*) FILTER (language IS NOT NULL) AS titled FROM results, nq GROUP BY ALL),
    (VALUES ('guardian'), ('reddit'), ('wikipedia'), ('gdelt')) s(source)""",
)
part(
    "outcomes",
    ("fetches",),
    """SELECT *, CASE h WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 4 THEN 'timeout' WHEN 5 THEN 'failed' WHEN 6 THEN 'failed' ELSE 'success' END AS status,
    CASE h WHEN 1 THEN 'rate limited' WHEN 2 THEN 'HTTP 503' WHEN 3 THEN 'request failed' WHEN 4 THEN 'source exceeded its deadline' WHEN 5 THEN 'invalid response' WHEN 6 THEN 'response misses its results' END AS error FROM fetches""",
)
