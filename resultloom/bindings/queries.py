"""Every bound query: a DataFrame over the tables, and reference SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resultloom.bindings import reference as R
from resultloom.bindings.reference import NEWEST, quoted, sql, type_order
from resultloom.bindings.tables import NOW, NOW_SECONDS, Tables
from resultloom.functions import scoring, text, urls
from resultloom.functions.scoring import DECAY_CANDIDATES, WEIGHT_SETS
from resultloom.operators import admission, dedup, fuzzy, ranking, statistics, views
from resultloom.operators.components import components
from resultloom.operators.skew import position
from resultloom.plans import bm25, evaluation, operations, postpass, quality
from resultloom.runtime import materialize, shared_folder, stored_once
from resultloom.schema import contract_violations, to_results
from resultloom.sources import payloads, sinks
from resultloom.streaming import jobs

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
REFERENCE: dict[str, str] = {}


def bound(name: str, reference: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if reference is not None:
            REFERENCE[name] = reference
        return query

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Plain comparable columns: long, double to 6 places, text times, joined lists."""
    def shown(name: str, kind: str):
        c = F.col(name)
        if kind in ("int", "smallint", "tinyint"):
            return c.cast("long")
        if kind in ("double", "float") or kind.startswith("decimal"):
            return F.round(c.cast("double"), 6)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if kind.startswith("array"):
            return F.array_join(c, ",")
        return c

    return df.select(*[shown(n, k).alias(n) for n, k in df.dtypes])


TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
PUBLISHED = TIME.format("published_at")

# --- sources ---------------------------------------------------------------


@bound("s1_contract", sql("SELECT search_id, id, 'title' AS missing_field FROM results WHERE title IS NULL", "results"))
def _(t: Tables) -> DataFrame:
    return contract_violations(to_results(t.results()))


LOST = {"title": "doc_id % 7 = 1", "url": "doc_id % 11 = 3", "source_type": "doc_id % 13 = 5", "retrieved_at": "doc_id % 17 = 2"}


@bound(
    "s1_contract_of_damaged_rows",
    sql(" UNION ALL ".join(f"SELECT search_id, id, '{name}' AS missing_field FROM results WHERE {rule}" for name, rule in LOST.items()), "results"),
)
def _(t: Tables) -> DataFrame:
    """Rows that lost mandatory fields, some of them several."""
    damaged = t.results().withColumns({name: F.expr(f"CASE WHEN NOT ({rule}) THEN {name} END") for name, rule in LOST.items()})
    return contract_violations(to_results(damaged))


@bound(
    "s2_news_records",
    sql(
        f"""SELECT search_id, 'The Guardian' AS source_name, title, nullif(substr(trim(coalesce(description, ''), chr(9)||chr(10)||chr(13)||' '), 1, 500), '') AS description,
        url, author, {PUBLISHED}, 'en' AS language FROM results WHERE title <> ''""",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = payloads.source_view(t.payloads(), "guardian")
    return tidy(rows.select("search_id", "source_name", "title", "description", "url", "author", "published_at", "language"))


@bound(
    "s3_social_records",
    sql(
        f"""SELECT search_id, 'social' AS source_type, title, nullif(substr(trim(coalesce(description, ''), chr(9)||chr(10)||chr(13)||' '), 1, 500), '') AS description,
        'https://www.reddit.com/r/' || language || '/comments/' || id || '/' AS url, nullif(author, '[deleted]') AS author, {PUBLISHED}
        FROM results WHERE trim(title) <> '' AND language IS NOT NULL""",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = payloads.source_view(t.payloads(), "reddit")
    return tidy(rows.select("search_id", "source_type", "title", "description", "url", "author", "published_at"))


@bound(
    "s4_reference_records",
    sql(
        """SELECT search_id, replace(title, '_', ' ') AS title, nullif(substr(trim(coalesce(description, ''), chr(9)||chr(10)||chr(13)||' '), 1, 500), '') AS description,
        'https://en.wikipedia.org/wiki/' || url_encode(replace(replace(title, '_', ' '), ' ', '_')) AS url, CAST(NULL AS VARCHAR) AS published_at
        FROM results WHERE title <> ''""",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = payloads.source_view(t.payloads(), "wikipedia")
    return tidy(rows.select("search_id", "title", "description", "url", "published_at"))


@bound(
    "s5_article_records",
    sql(
        "SELECT search_id, title, regexp_replace(url, '[?#].*', '') AS url, language FROM results WHERE trim(title) <> ''",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = payloads.article_records(t.payloads().filter("source = 'gdelt'"))
    return rows.select("search_id", "title", "url", "language")


@bound(
    "s6_fetch_outcomes",
    sql("SELECT search_id, source, fetched, status, error FROM outcomes", "outcomes"),
)
def _(t: Tables) -> DataFrame:
    rows = payloads.with_outcome(t.fetches())
    return rows.select("search_id", "source", F.unix_seconds("fetched_at").alias("fetched"), "status", "error")


@bound(
    "s7_timestamps",
    sql(f"SELECT id, {PUBLISHED}, published_at IS NULL AS missing, CAST(NULL AS VARCHAR) AS unreadable FROM results", "results"),
)
def _(t: Tables) -> DataFrame:
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = t.results().select(
        "id", payloads.iso_time(iso).alias("published_at"), F.col("published_at").isNull().alias("missing"),
        payloads.iso_time(F.concat(F.lit("x"), "title")).alias("unreadable"),
    )
    return tidy(rows)


@bound(
    "s7_spellings_of_time",
    sql(
        """SELECT id, strftime(CASE doc_id % 8 WHEN 1 THEN published_at - INTERVAL 150 MINUTE WHEN 3 THEN date_trunc('day', published_at)
        WHEN 4 THEN date_trunc('day', published_at) WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE published_at END, '%Y-%m-%d %H:%M:%S') AS published_at FROM results""",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    """The same instants in the spellings that sources use, two of them unreadable."""
    spelled = lambda form: F.date_format("published_at", form)
    text = F.expr("CAST(doc_id % 8 AS INT)")
    forms = F.array(
        spelled("yyyy-MM-dd'T'HH:mm:ss'Z'"), spelled("yyyy-MM-dd'T'HH:mm:ss'+02:30'"), spelled("yyyyMMdd'T'HHmmss'Z'"), spelled("yyyy-MM-dd"),
        spelled("yyyyMMdd"), spelled("yyyy-MM-dd HH:mm:ss',000'"), spelled("yyyy-MM-dd'T'HH:mm:ss' about'"), spelled("'2024-13-'dd"),
    )
    return tidy(t.results().select("id", payloads.iso_time(F.element_at(forms, text + 1)).alias("published_at")))


@bound(
    "s8_url_builders",
    sql(
        """SELECT page_id, spelling, 'https://en.wikipedia.org/wiki/' || url_encode(replace(title, ' ', '_')) AS article,
        'https://www.reddit.com/r/' || language || '/comments/' || page_id || '/' AS post,
        regexp_replace(url, '[?#].*', '') AS bare FROM pages_read""",
        "pages_read",
    ),
)
def _(t: Tables) -> DataFrame:
    null = F.lit(None).cast("string")
    return tidy(t.page_links().select(
        "page_id", "spelling",
        urls.article_url(F.col("title"), "en").alias("article"),
        urls.post_url(null, F.col("language"), F.col("page_id").cast("string"), null).alias("post"),
        urls.bare_url(F.col("url")).alias("bare"),
    ))


@bound(
    "s9_credentials_removed",
    sql("SELECT search_id, count(*) AS records, CAST(0 AS BIGINT) AS leaks FROM results WHERE trim(title) <> '' AND language IS NOT NULL GROUP BY 1", "results"),
)
def _(t: Tables) -> DataFrame:
    rows = payloads.social_records(t.payloads().filter("source = 'reddit'"))
    return rows.groupBy("search_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("raw").contains("modhash_token")).alias("leaks")
    )


@bound(
    "s9_credentials_at_any_depth",
    sql(
        """SELECT id, '{"id": ' || doc_id || ', "deep": {"lang": "' || coalesce(language, '') || '", "more": {}}, "list": [{"n": ' || doc_id % 10 || '}, "token"]}' AS cleaned FROM results""",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    """Keys that hold credentials at the top, within objects, within lists, and as mere values, which stay."""
    raw = F.concat(
        F.lit('{"id": '), "doc_id", F.lit(', "Access_Token": "x", "deep": {"lang": "'), F.coalesce("language", F.lit("")),
        F.lit('", "api-key": ["y"], "more": {"PASSWORD_hash": {"a": 1}}}, "list": [{"n": '), F.col("doc_id") % 10,
        F.lit(', "clientSecret": null}, "token"], "authorization": 1}'),
    )
    return t.results().select("id", payloads.drop_credentials(raw).alias("cleaned"))


@bound("s10_authors", sql("SELECT id, nullif(author, '[deleted]') AS author FROM results", "results"))
def _(t: Tables) -> DataFrame:
    return t.results().select("id", payloads.clean_author(F.col("author")).alias("author"))


@bound(
    "s11_fan_in",
    sql(
        """SELECT search_id, CASE source WHEN 'guardian' THEN 'The Guardian' WHEN 'reddit' THEN 'Reddit' ELSE 'Wikipedia' END AS source_name,
        CAST(sum(CASE source WHEN 'reddit' THEN titled ELSE n_rows END) AS BIGINT) AS records FROM outcomes
        WHERE status = 'success' AND source <> 'gdelt' GROUP BY 1, 2 HAVING records > 0""",
        "outcomes",
    ),
)
def _(t: Tables) -> DataFrame:
    return payloads.normalise(t.fetches()).groupBy("search_id", "source_name").agg(F.count("*").alias("records"))


@bound("s12_result_sink", sql("SELECT search_id, count(*) AS rows FROM results GROUP BY 1", "results"))
def _(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/results-{uuid4().hex}"
    sinks.append_results(to_results(t.results()), path, buckets=8)
    return t.spark.read.parquet(path).groupBy("search_id").agg(F.count("*").alias("rows"))


@bound(
    "s13_source_events",
    sql(
        """SELECT search_id, source_name, status, CASE WHEN status = 'success' THEN coalesce(found, 0) END AS result_count, latency_ms,
        nullif(status, 'success') AS error_type, error AS error_message FROM (
        SELECT search_id, CASE source WHEN 'guardian' THEN 'The Guardian' WHEN 'reddit' THEN 'Reddit' WHEN 'wikipedia' THEN 'Wikipedia' ELSE 'GDELT' END AS source_name,
        arg_max(status, (CASE WHEN status <> 'success' THEN 1 ELSE 0 END, fetched)) AS status,
        CAST(max(CASE WHEN h = 4 THEN 4500 ELSE 120 END) AS BIGINT) AS latency_ms,
        arg_max(coalesce(error, ''), (CASE WHEN status <> 'success' THEN 1 ELSE 0 END, fetched)) AS e, nullif(e, '') AS error,
        CAST(sum(CASE WHEN status <> 'success' OR source = 'gdelt' THEN 0 WHEN source = 'reddit' THEN titled ELSE n_rows END) AS BIGINT) AS found
        FROM outcomes GROUP BY 1, 2)""",
        "outcomes",
    ),
)
def _(t: Tables) -> DataFrame:
    fetches = materialize(t.fetches(), "fetches")
    events = sinks.source_events(fetches, payloads.normalise(fetches))
    return tidy(events.drop("created_at"))


@bound(
    "s14_source_view",
    sql("SELECT search_id, count(*) AS records FROM results WHERE trim(title) <> '' AND language IS NOT NULL GROUP BY 1", "results"),
)
def _(t: Tables) -> DataFrame:
    rows = payloads.source_view(t.payloads(), "reddit")
    return rows.groupBy("search_id").agg(F.count("*").alias("records"))


def _corpus(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = t.results().drop("doc_id").join(t.grades(), ["search_id", "id"]).withColumnRenamed("search_id", "query_id")
    gold = t.gold().select(F.col("gold").alias("group_id"), "id")
    return items, gold, t.unclear()


@bound(
    "s16_report_sink",
    sql("SELECT search_id, CAST(max(rel) AS BIGINT) AS best, count(*) AS items FROM grades GROUP BY 1", "grades"),
)
def _(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/report-{uuid4().hex}"
    report = t.grades().groupBy("search_id").agg(F.max("rel").alias("best"), F.count("*").alias("items"))
    sinks.write_report(report, path, ["search_id"])
    return tidy(t.spark.read.schema("best int, items long, search_id string").json(path))


@bound(
    "s17_corpus_violations",
    sql(
        """SELECT 'group_too_small' AS rule, gold AS subject FROM gold GROUP BY gold HAVING count(*) < 2
        UNION ALL SELECT 'title_missing', id FROM results WHERE title = ''
        UNION ALL SELECT 'pair_item_unknown', i FROM (SELECT unnest([a, b]) AS i FROM unclear) WHERE i NOT IN (SELECT id FROM results)""",
        "gold", "results", "unclear",
    ),
)
def _(t: Tables) -> DataFrame:
    return quality.corpus_violations(*_corpus(t))


@bound(
    "a20_corpus_summary",
    sql(
        """SELECT 'queries' AS what, count(DISTINCT search_id) AS n FROM results UNION ALL SELECT 'items', count(*) FROM results
        UNION ALL SELECT 'groups', count(DISTINCT gold) FROM gold UNION ALL SELECT 'ambiguous_pairs', count(*) FROM unclear""",
        "results", "gold", "unclear",
    ),
)
def _(t: Tables) -> DataFrame:
    return quality.corpus_summary(*_corpus(t))


# --- scalar functions ------------------------------------------------------


@bound(
    "x1_canonical_url",
    sql(
        f"SELECT page_id, spelling, {R.canonical_url('url')} AS canonical, sha256({R.canonical_url('url')}) AS dedupe_key FROM pages_read",
        "pages_read",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = t.page_links().withColumn("canonical", urls.canonical_url(F.col("url")))
    return tidy(rows.select("page_id", "spelling", "canonical", urls.dedupe_key(F.col("canonical")).alias("dedupe_key")))


@bound("x4_norm_title", sql(f"SELECT id, {R.norm_title('title')} AS norm_title FROM variants", "variants"))
def _(t: Tables) -> DataFrame:
    return text.with_norm_title(t.variants()).select("id", "norm_title")


@bound(
    "x5_tokens",
    sql(
        f"""SELECT id, len(list_distinct({R.tokens('description')})) AS distinct_words, len({R.content_tokens('description')}) AS content_words,
        array_to_string({R.content_tokens('title')}, ' ') AS title_words FROM results""",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(t.results().select(
        "id",
        F.size(text.token_set(F.col("description"))).alias("distinct_words"),
        F.size(text.content_tokens(F.col("description"))).alias("content_words"),
        F.array_join(text.content_tokens(F.col("title")), " ").alias("title_words"),
    ))


@bound("x7_overlap", sql("SELECT search_id, id, raw_relevance FROM overlap", "overlap"))
def _(t: Tables) -> DataFrame:
    return tidy(ranking.with_overlap(t.results(), t.searches()).select("search_id", "id", "raw_relevance"))


@bound(
    "x10_components",
    sql(
        f"""SELECT search_id, id, round(relevance, 6) AS relevance, round(freshness, 6) AS freshness, round(quality, 6) AS quality,
        round({R.weighted(WEIGHT_SETS['design'])}, 6) AS rank_score FROM components""",
        "components",
    ),
)
def _(t: Tables) -> DataFrame:
    parts = ranking.with_components(t.results(), t.searches(), NOW).withColumn("scored_type", F.col("source_type"))
    scored = ranking.with_score(parts)
    return tidy(scored.select("search_id", "id", "relevance", "freshness", "quality", "rank_score"))


@bound(
    "x18_decay_curves",
    sql("SELECT curve, search_id, id, round(fresh, 6) AS fresh FROM curves", "curves"),
)
def _(t: Tables) -> DataFrame:
    return tidy(_curves(t).select("curve", "search_id", "id", "fresh"))


@bound(
    "x19_age_for_freshness",
    sql(
        f"""SELECT id, CAST(round(greatest(0, {R.age_hours()})) AS BIGINT) AS age, true AS inverts
        FROM results WHERE source_type <> 'reference' AND published_at IS NOT NULL""",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    at = scoring.instant(NOW)
    kind, pub = F.col("source_type"), F.col("published_at")
    fresh = scoring.freshness(pub, kind, at)
    age = F.when(kind == "news", scoring.age_for(fresh, 24.0)).otherwise(scoring.age_for(fresh, 12.0))
    true_age = F.greatest(F.lit(0.0), scoring.age_hours(pub, at))
    # An old page's freshness differs from its floor in the last digits only: the inverse must
    # give that freshness again, as closely as doubles tell.
    again = 0.05 + 0.95 * F.pow(F.lit(2.0), -age / F.when(kind == "news", 24.0).otherwise(12.0))
    inverts = F.abs(again - fresh) <= 1e-12 * fresh
    rows = t.results().filter((kind != "reference") & pub.isNotNull())
    return rows.select("id", F.round(true_age).cast("long").alias("age"), F.coalesce(inverts, fresh <= 0.05 + 1e-15).alias("inverts"))


@bound(
    "x20_gain_and_discount",
    sql("SELECT search_id, id, round((pow(2, rel) - 1) / log2(CAST(id AS BIGINT) % 10 + 2), 6) AS gain FROM grades", "grades"),
)
def _(t: Tables) -> DataFrame:
    place = F.col("id").cast("long") % 10 + 1
    return tidy(t.grades().select("search_id", "id", (evaluation.gain(F.col("rel")) / evaluation.discount(place)).alias("gain")))


@bound(
    "x22_display",
    sql(
        """SELECT id, CASE WHEN length(t) <= 46 THEN t ELSE substr(t, 1, 43) || '...' END AS line, coalesce(strftime(published_at, '%Y-%m-%d %H:%M:%S'), 'not provided') AS shown
        FROM (SELECT *, replace(coalesce(description, title), chr(10), ' ') AS t FROM results)""",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    body = F.coalesce("description", "title")
    return t.results().select("id", text.shorten(body).alias("line"), text.shown_time(F.col("published_at")).alias("shown"))


# --- linking ---------------------------------------------------------------


@bound(
    "j1_url_edges",
    sql(
        "SELECT search_id, a, id AS b, 'canonical_url' AS method FROM (SELECT *, min(id) OVER (PARTITION BY search_id, canonical_url) AS a FROM keyed) WHERE a <> id",
        "keyed",
    ),
)
def _(t: Tables) -> DataFrame:
    return dedup.url_edges(dedup.with_keys(t.results()))


@bound(
    "j2_title_edges",
    sql(
        "SELECT search_id, a, id AS b, 'normalized_title' AS method FROM (SELECT *, min(id) OVER (PARTITION BY search_id, source_type, norm_title) AS a FROM keyed WHERE norm_title <> '') WHERE a <> id",
        "keyed",
    ),
)
def _(t: Tables) -> DataFrame:
    return dedup.title_edges(dedup.with_keys(t.results()))


@bound(
    "j3_title_matches",
    sql("SELECT search_id, source_type, joined_a AS words_a, joined_b AS words_b, round(score, 6) AS score FROM v_matches", "v_matches"),
)
def _(t: Tables) -> DataFrame:
    return _title_matches(t)


def _title_matches(t: Tables, **kw) -> DataFrame:
    keyed = dedup.with_keys(t.variants()).select("search_id", "source_type", "norm_title")
    rows = materialize(fuzzy.with_word_key(fuzzy.admissible(keyed)), "words")
    matches = fuzzy.title_matches(rows, **kw)
    names = rows.groupBy("word_key").agg(F.first(F.array_join("words", " ")).alias("joined"))
    a = names.select(F.col("word_key").alias("key_a"), F.col("joined").alias("ja"))
    b = names.select(F.col("word_key").alias("key_b"), F.col("joined").alias("jb"))
    told = matches.join(a, "key_a").join(b, "key_b")
    return tidy(told.select("search_id", "source_type", F.least("ja", "jb").alias("words_a"), F.greatest("ja", "jb").alias("words_b"), "score"))


@bound("j3_title_matches_blocked", REFERENCE["j3_title_matches"])
def _(t: Tables) -> DataFrame:
    """As ``j3_title_matches``, with every search treated as too large to be compared directly."""
    return _title_matches(t, small_scope=0)


@bound(
    "g1_components",
    sql("SELECT search_id || '/' || id AS node, search_id || '/' || component AS component FROM exact_member", "exact_member"),
)
def _(t: Tables) -> DataFrame:
    keyed = materialize(dedup.with_keys(t.results()).drop("description"), "keyed")
    edges = dedup.url_edges(keyed).unionByName(dedup.title_edges(keyed))
    named = lambda c: F.concat_ws("/", "search_id", c)
    return components(edges.select(named("a").alias("a"), named("b").alias("b")))


GROUP_COLUMNS = ["search_id", "first_member", "member_count", "canonical_id", "methods"]


@bound("g2_exact_groups", sql("SELECT search_id, first_member, member_count, canonical_id, methods FROM exact_groups", "exact_groups"))
def _(t: Tables) -> DataFrame:
    return tidy(dedup.exact_groups(t.results())[1].select(GROUP_COLUMNS))


@bound("g3_fuzzy_groups", sql("SELECT search_id, first_member, member_count, canonical_id, methods FROM fuzzy_groups", "fuzzy_groups"))
def _(t: Tables) -> DataFrame:
    return tidy(dedup.fuzzy_groups(t.variants())[1].select(GROUP_COLUMNS))


@bound("g4_duplicate_groups", sql("SELECT search_id, first_member, member_count, canonical_id, methods FROM all_groups", "all_groups"))
def _(t: Tables) -> DataFrame:
    return tidy(dedup.all_groups(t.results())[1].select(GROUP_COLUMNS))


def _annotated(t: Tables) -> tuple[DataFrame, DataFrame]:
    return dedup.annotate(t.results().drop("doc_id"))


def _annotated_overlap(t: Tables) -> DataFrame:
    return dedup.annotate(ranking.with_overlap(t.results().drop("doc_id"), t.searches()))[0]


@bound(
    "g5_annotated",
    sql("SELECT search_id, id, sha256(canonical_url) AS dedupe_key, CASE WHEN grp IS NOT NULL THEN sha256(search_id || chr(31) || grp) END AS duplicate_group_id, is_duplicate FROM annotated", "annotated"),
)
def _(t: Tables) -> DataFrame:
    return _annotated(t)[0].select("search_id", "id", "dedupe_key", "duplicate_group_id", "is_duplicate")


@bound(
    "a4_dedup_stats",
    sql(
        """SELECT s.search_id, count(g.first_member) AS groups, CAST(coalesce(sum(member_count - 1), 0) AS BIGINT) AS duplicates
        FROM searches s LEFT JOIN all_groups g USING (search_id) GROUP BY 1""",
        "searches", "all_groups",
    ),
)
def _(t: Tables) -> DataFrame:
    return dedup.dedup_stats(dedup.all_groups(t.results())[1], t.searches())


@bound(
    "a23_also_reported_by",
    sql(
        "SELECT search_id, sha256(search_id || chr(31) || grp) AS duplicate_group_id, source_name, count(*) AS rows FROM annotated WHERE grp IS NOT NULL GROUP BY ALL",
        "annotated",
    ),
)
def _(t: Tables) -> DataFrame:
    return dedup.also_reported_by(_annotated(t)[0])[0]


@bound(
    "a23_reported_urls",
    sql("SELECT DISTINCT search_id, sha256(search_id || chr(31) || grp) AS duplicate_group_id, url FROM annotated WHERE grp IS NOT NULL", "annotated"),
)
def _(t: Tables) -> DataFrame:
    return dedup.also_reported_by(_annotated(t)[0])[1]


@bound(
    "j7_group_members",
    sql("SELECT search_id, first_member, count(*) AS members, max(member_count) AS member_count FROM exact_groups g JOIN (SELECT search_id, id, component AS first_member FROM exact_member) m USING (search_id, first_member) GROUP BY ALL", "exact_groups"),
)
def _(t: Tables) -> DataFrame:
    members, groups = dedup.exact_groups(t.results())
    joined = groups.select("component", "first_member", "member_count").join(members, "component")
    return joined.groupBy("search_id", "first_member").agg(F.count("*").alias("members"), F.max("member_count").alias("member_count"))


@bound(
    "u1_edges_by_method",
    sql("SELECT search_id, method, count(*) AS pairs FROM exact_pairs GROUP BY ALL", "exact_pairs"),
)
def _(t: Tables) -> DataFrame:
    keyed = dedup.with_keys(t.results())
    by_url = evaluation.pair_counts(keyed, ["search_id"], ["search_id", "canonical_url"], "pairs")
    named = keyed.filter(F.col("norm_title") != "")
    by_title = evaluation.pair_counts(named, ["search_id"], ["search_id", "source_type", "norm_title"], "pairs")
    both = by_url.withColumn("method", F.lit(dedup.URL_METHOD)).unionByName(
        by_title.withColumn("method", F.lit(dedup.TITLE_METHOD))
    )
    return both.filter("pairs > 0").select("search_id", "method", "pairs")


# --- filters, views, order -------------------------------------------------


@bound("f1_source_types", sql("SELECT id, source_type FROM results WHERE source_type IN ('news', 'social')", "results"))
def _(t: Tables) -> DataFrame:
    return views.filtered(t.results(), source_types=["news", "social"]).select("id", "source_type")


@bound("f2_language", sql("SELECT id, language FROM results WHERE language = 'en'", "results"))
def _(t: Tables) -> DataFrame:
    return views.filtered(t.results(), language="en").select("id", "language")


@bound("f3_canonical_only", sql("SELECT search_id, id FROM annotated WHERE NOT is_duplicate", "annotated"))
def _(t: Tables) -> DataFrame:
    return views.filtered(_annotated(t)[0], duplicates="canonical").select("search_id", "id")


@bound(
    "f4_time_window",
    sql(
        f"""SELECT r.search_id, r.id, {PUBLISHED} FROM results r JOIN searches s USING (search_id)
        WHERE source_type = 'reference' OR published_at >= coalesce(completed_at, created_at) - INTERVAL 168 HOURS""",
        "results", "searches",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(views.filtered(t.results(), t.searches(), time="7d").select("search_id", "id", "published_at"))


@bound(
    "f5_cutoffs",
    sql("SELECT search_id, strftime(coalesce(completed_at, created_at) - INTERVAL 24 HOURS, '%Y-%m-%d %H:%M:%S') AS cutoff FROM searches", "searches"),
)
def _(t: Tables) -> DataFrame:
    return tidy(t.searches().select("search_id", views.cutoff("24h").alias("cutoff")))


F6 = """FROM placed p JOIN searches s USING (search_id) WHERE source_type IN ('news', 'reference') AND language = 'en' AND NOT is_duplicate
    AND (source_type = 'reference' OR published_at >= coalesce(completed_at, created_at) - INTERVAL 720 HOURS)"""


def _finished(t: Tables, **kw) -> DataFrame:
    """Annotated and ranked results of all searches, computed."""
    ranked, _ = postpass.finish(t.results().drop("doc_id"), t.searches(), NOW, **kw)
    return ranked


def _stored(t: Tables) -> DataFrame:
    """Annotated and ranked results, read from where the finished searches stored them.

    The first query that asks for them stores them; a changed table is another store.
    """
    files = sorted(f for name in ("documents", "benchmark") for f in t.read(name).inputFiles())
    sizes = [t.read(name).count() for name in ("documents", "benchmark")]
    name = hashlib.sha256("|".join([*files, *map(str, sizes)]).encode()).hexdigest()[:20]
    path = stored_once(t.spark, f"store-{name}", lambda folder: sinks.store_ranked(_finished(t), folder, buckets=8))
    return t.spark.read.parquet(path).drop("bucket")


def _view(t: Tables, stored: DataFrame) -> DataFrame:
    return views.filtered(
        stored, t.searches(), source_types=["news", "reference"], time="30d", duplicates="canonical", language="en"
    )


@bound("f6_view", sql(f"SELECT p.search_id, p.id, rank_position {F6}", "placed", "searches"))
def _(t: Tables) -> DataFrame:
    return _view(t, _stored(t)).select("search_id", "id", "rank_position")


@bound(
    "f8_clean_queries",
    sql(
        r"""SELECT search_id, trim(asked) AS query, lower(trim(regexp_replace(asked, '\s+', ' ', 'g'))) AS normalized_query, nullif(w, 0) AS window_hours
        FROM (SELECT 's' || item_id AS search_id, '  ' || text || ' ' AS asked, item_id * 400 AS w FROM benchmark) WHERE length(trim(asked)) BETWEEN 1 AND 200 AND w <= 8760"""
    ),
)
def _(t: Tables) -> DataFrame:
    asked = t.read("benchmark").select(
        F.concat(F.lit("s"), "item_id").alias("search_id"),
        F.concat(F.lit("  "), "text", F.lit(" ")).alias("query"),
        (F.col("item_id") * 400).alias("window_hours"),
    )
    return text.clean_queries(asked).select("search_id", "query", "normalized_query", "window_hours")


@bound(
    "f10_public_columns",
    sql(
        f"""SELECT search_id, source_type, source_name, title, description, url, author, {PUBLISHED}, {TIME.format('retrieved_at')}, language, is_duplicate,
        CASE WHEN grp IS NOT NULL THEN sha256(search_id || chr(31) || grp) END AS duplicate_group_id FROM annotated""",
        "annotated",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(views.public(dedup.with_texts(_annotated(t)[0], t.results())))


@bound(
    "f11_one_search",
    sql("SELECT search_id, status FROM searches WHERE search_id = 's7'", "searches"),
)
def _(t: Tables) -> DataFrame:
    return views.find_search(t.searches(), "s7").select("search_id", "status")


@bound(
    "f12_fuzzy_admissible",
    sql("SELECT id, array_to_string(words, ',') AS words FROM v_spoken", "v_spoken"),
)
def _(t: Tables) -> DataFrame:
    return tidy(fuzzy.admissible(dedup.with_keys(t.variants())).select("id", "words"))


@bound(
    "o2_serving_order",
    sql(f"SELECT p.search_id, p.id, row_number() OVER (PARTITION BY p.search_id ORDER BY rank_position, p.id) AS view_position {F6}", "placed", "searches"),
)
def _(t: Tables) -> DataFrame:
    return position(_view(t, _stored(t)), ["search_id"], views.serving_order(), "view_position").select("search_id", "id", "view_position")


@bound(
    "o2_running_searches",
    sql(
        f"""SELECT search_id, id, row_number() OVER (PARTITION BY search_id ORDER BY CASE WHEN status = 'completed' THEN rank_position END NULLS LAST,
        CASE WHEN status = 'running' THEN {type_order('source_type')} END, CASE WHEN status = 'running' THEN published_at END DESC NULLS LAST,
        CASE WHEN status = 'running' THEN url END, id) AS view_position FROM placed JOIN searches USING (search_id)""",
        "placed", "searches",
    ),
)
def _(t: Tables) -> DataFrame:
    """Rows of searches that still run have no place yet, and are shown by type, time and URL."""
    running = t.searches().filter("status = 'running'").select("search_id", F.lit(True).alias("running"))
    shown = _stored(t).join(running, "search_id", "left").withColumn("rank_position", F.when(F.col("running").isNull(), F.col("rank_position")))
    return position(shown, ["search_id"], views.serving_order(), "view_position").select("search_id", "id", "view_position")


@bound(
    "o5_pages",
    sql("SELECT search_id, id, rank_position + 1 AS view_position FROM placed WHERE rank_position BETWEEN 5 AND 9", "placed"),
)
def _(t: Tables) -> DataFrame:
    return sinks.stored_pages(_stored(t), page=2, per_page=5).select("search_id", "id", "view_position")


@bound("o5_filtered_pages", sql(f"SELECT * FROM (SELECT p.search_id, p.id, row_number() OVER (PARTITION BY p.search_id ORDER BY rank_position) AS view_position {F6}) WHERE view_position <= 3", "placed", "searches"))
def _(t: Tables) -> DataFrame:
    """Pages of a view that leaves rows out: places are counted anew."""
    return views.pages(_view(t, _stored(t)), page=1, per_page=3).select("search_id", "id", "view_position")


@bound(
    "a1_view_totals",
    sql("SELECT search_id, count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM results WHERE source_type = 'news' GROUP BY 1", "results"),
)
def _(t: Tables) -> DataFrame:
    return views.totals(views.filtered(t.results(), source_types=["news"]))


@bound(
    "a2_result_counts",
    sql("SELECT s.search_id, count(r.id) AS result_count FROM searches s LEFT JOIN results r USING (search_id) GROUP BY 1", "searches", "results"),
)
def _(t: Tables) -> DataFrame:
    return views.result_counts(t.searches(), t.results()).select("search_id", "result_count")


@bound(
    "o6_history",
    sql(
        f"""SELECT search_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, (SELECT count(*) FROM results r WHERE r.search_id = s.search_id) AS result_count
        FROM searches s ORDER BY s.created_at DESC, search_id LIMIT 20""",
        "searches", "results",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(views.history(t.searches(), t.results()).select("search_id", "status", "created_at", "result_count"))


@bound(
    "e17_search_detail",
    sql(
        """SELECT s.search_id, s.status, (SELECT count(*) FROM results r WHERE r.search_id = s.search_id) AS result_count, source_name AS source,
        e.status AS source_status, e.latency_ms AS source_latency_ms FROM searches s LEFT JOIN (SELECT *, 's' || search_id AS sid FROM source_events) e ON e.sid = s.search_id""",
        "searches", "results", "source_events",
    ),
)
def _(t: Tables) -> DataFrame:
    events = t.events().withColumn("search_id", F.concat(F.lit("s"), "search_id"))
    detail = views.search_detail(t.searches(), events, t.results())
    return tidy(detail.select("search_id", "status", "result_count", "source", "source_status", "source_latency_ms"))


# --- ranking ---------------------------------------------------------------


@bound(
    "j4_inherited_components",
    sql("SELECT search_id, id, round(relevance, 6) AS relevance, round(freshness, 6) AS freshness, round(quality, 6) AS quality, scored_type FROM inherited", "inherited"),
)
def _(t: Tables) -> DataFrame:
    annotated = _annotated_overlap(t)
    parts = ranking.inherit_from_canonical(ranking.with_components(annotated, t.searches(), NOW))
    return tidy(parts.select("search_id", "id", "relevance", "freshness", "quality", "scored_type"))


@bound(
    "w2_bands",
    sql("SELECT candidate, search_id, id, band FROM wide_banded", "wide_banded"),
)
def _(t: Tables) -> DataFrame:
    parts = ranking.with_components(t.results(), t.searches(), NOW).withColumn("scored_type", F.col("source_type"))
    banded = ranking.with_bands(ranking.with_score(parts))
    return tidy(banded.select(F.lit("C4_design_diversity").alias("candidate"), "search_id", "id", "band"))


@bound("w2_bands_searched", REFERENCE["w2_bands"])
def _(t: Tables) -> DataFrame:
    parts = ranking.with_components(t.results(), t.searches(), NOW).withColumn("scored_type", F.col("source_type"))
    banded = ranking.with_bands(ranking.with_score(parts), task_rows=0)
    return tidy(banded.select(F.lit("C4_design_diversity").alias("candidate"), "search_id", "id", "band"))


@bound(
    "e1_rank",
    sql("SELECT search_id, id, round(rank_score, 6) AS rank_score, rank_position FROM placed", "placed"),
)
def _(t: Tables) -> DataFrame:
    return tidy(_finished(t).select("search_id", "id", "rank_score", "rank_position"))


@bound("e1_rank_in_slices", REFERENCE["e1_rank"])
def _(t: Tables) -> DataFrame:
    """As ``e1_rank``, with every search treated as too large for one task."""
    return tidy(_finished(t, task_rows=0).select("search_id", "id", "rank_score", "rank_position"))


@bound("e2_stored_ranking", REFERENCE["e1_rank"])
def _(t: Tables) -> DataFrame:
    return tidy(_stored(t).select("search_id", "id", "rank_score", "rank_position"))


@bound(
    "w3_type_turns",
    sql("SELECT search_id, id, band, turn FROM turned", "turned"),
)
def _(t: Tables) -> DataFrame:
    annotated = _annotated_overlap(t)
    ranked = ranking.rank_results(annotated, t.searches(), NOW)
    return tidy(ranked.select("search_id", "id", "band", "turn"))


@bound(
    "o1_score_order",
    sql("SELECT search_id, id, position FROM candidates WHERE candidate = 'C1_design'", "candidates"),
)
def _(t: Tables) -> DataFrame:
    rows = t.results().withColumn("duplicate_group_id", F.lit(None).cast("string")).withColumn("is_duplicate", F.lit(False))
    ranked = ranking.rank_results(rows, t.searches(), NOW, diversity=False)
    return ranked.select("search_id", "id", (F.col("rank_position") + 1).alias("position"))


@bound("o3_baseline_order", sql("SELECT search_id, id, raw_relevance, position FROM lexical", "lexical"))
def _(t: Tables) -> DataFrame:
    return tidy(ranking.baseline_positions(t.results(), t.searches()).select("search_id", "id", "raw_relevance", "position"))


@bound("o8_top_10", sql("SELECT search_id, id, position FROM lexical WHERE position <= 10", "lexical"))
def _(t: Tables) -> DataFrame:
    ranked = ranking.baseline_positions(t.results(), t.searches())
    return ranked.filter("position <= 10").select("search_id", "id", "position")


# --- evaluation ------------------------------------------------------------


@bound(
    "e6_ranking_metrics",
    sql(
        "SELECT search_id, round(precision_at_5, 6) AS precision_at_5, round(precision_at_10, 6) AS precision_at_10, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg_at_10, 6) AS ndcg_at_10 FROM lexical_metrics",
        "lexical_metrics",
    ),
)
def _(t: Tables) -> DataFrame:
    ranked = ranking.baseline_positions(t.results(), t.searches())
    return tidy(evaluation.ranking_metrics(ranked, t.grades()).select("search_id", *evaluation.METRICS))


@bound("e3_baseline_evaluation", sql(f"SELECT count(*) AS queries, {R.MEANS} FROM lexical_metrics", "lexical_metrics"))
def _(t: Tables) -> DataFrame:
    ranked = ranking.baseline_positions(t.results(), t.searches())
    return tidy(evaluation.macro_means(evaluation.ranking_metrics(ranked, t.grades())))


@bound(
    "e4_candidate_sweep",
    sql(
        f"SELECT candidate, count(*) AS queries, {R.MEANS}, round(avg(rel0_in_top10), 6) AS rel0_in_top10, round(avg(fresh_junk_in_top10), 6) AS fresh_junk_in_top10 FROM candidate_metrics GROUP BY 1",
        "candidate_metrics",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(evaluation.candidate_sweep(t.results(), t.searches(), t.grades(), NOW))


@bound(
    "e4_candidates_of_a_table",
    sql(
        f"SELECT candidate, count(*) AS queries, {R.MEANS}, round(avg(rel0_in_top10), 6) AS rel0_in_top10, round(avg(fresh_junk_in_top10), 6) AS fresh_junk_in_top10 FROM table_metrics GROUP BY 1",
        "table_metrics",
    ),
)
def _(t: Tables) -> DataFrame:
    """Candidates dealt from a table, scored by a product instead of a sum."""
    key = F.col("r_regionkey")
    kinds = F.explode(F.array(F.lit("news"), F.lit("social")))
    candidates = t.read("region").select(
        F.concat(F.lit("t"), key).alias("candidate"), (key % 2 == 0).alias("diverse"), kinds.alias("source_type"),
        F.lit(0.75).alias("relevance"), (key / 4).alias("freshness"), (key / 16).alias("quality"),
    )
    product = lambda rel, fresh, good, w: w["relevance"] * rel * (1 - w["freshness"] + w["freshness"] * fresh) + w["quality"] * good
    return tidy(evaluation.candidate_sweep(t.results(), t.searches(), t.grades(), NOW, candidates, product))


@bound(
    "e8_filter_sweep",
    sql(
        f"""SELECT view, count(*) AS queries, round(avg(coalesce(kept, 0)), 6) AS kept, round(avg(total), 6) AS total,
        round(avg(CASE WHEN all1 = 0 THEN 1.0 ELSE coalesce(kept1, 0)::DOUBLE / all1 END), 6) AS rel1_coverage,
        round(avg(CASE WHEN all2 = 0 THEN 1.0 ELSE coalesce(kept2, 0)::DOUBLE / all2 END), 6) AS rel2_coverage,
        round(avg(coalesce(precision_at_5, 0)), 6) AS precision_at_5, round(avg(coalesce(precision_at_10, 0)), 6) AS precision_at_10,
        round(avg(coalesce(reciprocal_rank, 0)), 6) AS reciprocal_rank, round(avg(coalesce(ndcg_at_10, 0)), 6) AS ndcg_at_10,
        round(avg(coalesce(rel0_in_top10, 0)), 6) AS rel0_in_top10, round(avg(coalesce(fresh_junk_in_top10, 0)), 6) AS fresh_junk_in_top10
        FROM (SELECT * FROM (SELECT search_id, count(*) AS total, count(*) FILTER (rel >= 1) AS all1, count(*) FILTER (rel >= 2) AS all2 FROM grades GROUP BY 1),
        (VALUES {', '.join(f"('{n}')" for n in evaluation.FILTER_CONFIGS)}) v(view)) LEFT JOIN view_metrics USING (view, search_id) GROUP BY 1""",
        "view_metrics", "grades",
    ),
)
def _(t: Tables) -> DataFrame:
    stored = materialize(_stored(t).drop("title"), "stored")
    return tidy(evaluation.filter_sweep(stored, t.grades(), NOW))


@bound(
    "a13_language_coverage",
    sql(
        "SELECT source_name, count(*) AS rows, count(language) AS with_language, round(count(language) / count(*), 6) AS coverage FROM results GROUP BY ROLLUP (source_name)",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(evaluation.language_coverage(t.results()))


def _curves(t: Tables) -> DataFrame:
    items = t.results().select("search_id", "id", "source_type", "published_at").join(t.grades(), ["search_id", "id"])
    return evaluation.curve_scores(items, NOW)


@bound(
    "a9_curve_distributions",
    sql(
        """SELECT curve, source_type, count(*) AS n, round(min(fresh), 6) AS min, round(max(fresh), 6) AS max,
        round(avg(CASE WHEN fresh < 0.5 THEN 100.0 ELSE 0.0 END), 6) AS pct_below_half, round(median(fresh), 6) AS median FROM curves GROUP BY ALL""",
        "curves",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(evaluation.curve_distributions(materialize(_curves(t), "curves")))


@bound(
    "a10_curve_tension",
    sql(
        """SELECT curve, count(*) FILTER (rel = 0 AND fresh >= 0.9) AS irrelevant_fresh_09, count(*) FILTER (rel = 0 AND fresh >= 0.7) AS irrelevant_fresh_07,
        count(*) FILTER (rel >= 1 AND fresh < 0.5) AS relevant_old FROM curves GROUP BY 1""",
        "curves",
    ),
)
def _(t: Tables) -> DataFrame:
    return evaluation.curve_tension(_curves(t))


@bound(
    "e7_spearman",
    sql(
        """SELECT curve, source_type, count(*) AS n, round(CASE WHEN count(*) < 3 OR stddev_pop(rx) = 0 OR stddev_pop(ry) = 0 THEN 'nan'::DOUBLE ELSE corr(rx, ry) END, 6) AS rho FROM (
        SELECT *, rank() OVER (PARTITION BY curve, source_type ORDER BY fresh) + (count(*) OVER (PARTITION BY curve, source_type, fresh) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY curve, source_type ORDER BY rel) + (count(*) OVER (PARTITION BY curve, source_type, rel) - 1) / 2.0 AS ry
        FROM (SELECT curve, source_type, fresh, rel FROM curves UNION ALL SELECT curve, 'all', fresh, rel FROM curves)) GROUP BY ALL""",
        "curves",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(evaluation.curve_correlation(materialize(_curves(t), "curves")))


@bound(
    "w5_mid_ranks",
    sql(
        f"""SELECT DISTINCT source_type, round(fresh, 6) AS fresh, rank() OVER (PARTITION BY source_type ORDER BY fresh) + (count(*) OVER (PARTITION BY source_type, fresh) - 1) / 2.0::DOUBLE AS mid_rank
        FROM curves WHERE curve = 'design'""",
        "curves",
    ),
)
def _(t: Tables) -> DataFrame:
    design = _curves(t).filter("curve = 'design'")
    return tidy(statistics.mid_ranks(design, ["source_type"], "fresh", "mid_rank"))


@bound("w5_mid_ranks_in_slices", REFERENCE["w5_mid_ranks"])
def _(t: Tables) -> DataFrame:
    design = _curves(t).filter("curve = 'design'")
    return tidy(statistics.mid_ranks(design, ["source_type"], "fresh", "mid_rank", task_rows=0))


PROBE_AGES = (0, 1, 12, 24, 48, 168)


@bound(
    "e5_curve_grid",
    sql(
        f"""SELECT source_type, age_hours, {", ".join(f'round({R.freshness(d)}, 6) AS "{n}"' for n, d in DECAY_CANDIDATES.items())} FROM (
        SELECT source_type, age_hours, TIMESTAMP '{NOW}' - to_hours(CAST(age_hours AS INT)) AS published_at
        FROM (SELECT DISTINCT source_type FROM results), (SELECT unnest({[float(a) for a in PROBE_AGES]}::DOUBLE[]) AS age_hours))""",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(evaluation.curve_grid(t.results(), PROBE_AGES))


@bound(
    "e5_curves_of_a_table",
    sql(
        f"SELECT curve, source_type, count(*) AS n, round(sum(fresh), 4) AS total FROM ({' UNION ALL '.join(R.table_curve(k) for k in range(25))} UNION ALL {R.table_curve(None)}) GROUP BY ALL",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    """Curves that are rows of a table, and one that is a function."""
    key = F.col("n_nationkey")
    shape = F.element_at(F.array(*[F.lit(s) for s in ("exp", "linear30d", "step", "constant")]), (key % 4 + 1).cast("int"))
    curves = t.read("nation").select(
        F.concat(F.lit("n"), key).alias("curve"), shape.alias("shape"), (6.0 + key).alias("news_half_life"), (3.0 + key).alias("social_half_life"),
        (F.col("n_regionkey") / 16).alias("floor"), F.lit(0.75).alias("reference"), F.lit(0.25).alias("missing"),
    )
    items = t.results().withColumn("rel", F.lit(0))
    own = lambda published, kind, now: F.when(published.isNull(), 0.0).otherwise(1 / (1 + scoring.age_hours(published, now)))
    scores = evaluation.curve_scores(items, NOW, curves).unionByName(evaluation.curve_scores(items, NOW, {"own": own}))
    return scores.groupBy("curve", "source_type").agg(F.count("*").alias("n"), F.round(F.sum("fresh"), 4).alias("total"))


@bound(
    "e5_freshest",
    sql(
        f"SELECT id, {PUBLISHED}, round({R.age_hours()}, 2) AS age_hours FROM results r ORDER BY r.published_at DESC NULLS LAST, id LIMIT 10",
        "results",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(evaluation.freshest(t.results(), NOW).select("id", "published_at", "age_hours"))


@bound(
    "a18_span_days",
    sql(f"SELECT CAST(floor(({'epoch_us(' + R.NOW + ')'} - min(epoch_us(published_at))) / 86400000000) AS BIGINT) AS span_days FROM results", "results"),
)
def _(t: Tables) -> DataFrame:
    return evaluation.span_days(t.results(), NOW)


@bound(
    "e14_freshness_invariants",
    sql(
        """SELECT bool_and(fresh BETWEEN 0 AND 1) AS missing_timestamp_handled, bool_and(fresh BETWEEN 0 AND 1) AS bounded,
        count(*) > 0 AS monotonic_with_age, count(*) > 0 AS future_clamped, count(*) > 0 AS retrieved_at_ignored FROM curves WHERE curve = 'design'""",
        "curves",
    ),
)
def _(t: Tables) -> DataFrame:
    return evaluation.freshness_invariants(t.results(), NOW)


@bound(
    "e15_gold_annotations",
    sql(
        """SELECT search_id, id, gold AS group_id, id <> arg_min(id, (source_name, url, id)) OVER (PARTITION BY search_id, gold) AS is_duplicate FROM results JOIN gold USING (search_id, id)
        QUALIFY count(*) OVER (PARTITION BY search_id, gold) > 1""",
        "results", "gold",
    ),
)
def _(t: Tables) -> DataFrame:
    gold = t.gold().select("id", F.col("gold").alias("group_id"))
    return evaluation.gold_annotations(t.results(), gold)


@bound("a14_grade_histogram", sql('SELECT search_id, count(*) FILTER (rel = 0) AS "0", count(*) FILTER (rel = 1) AS "1", count(*) FILTER (rel = 2) AS "2" FROM grades GROUP BY 1', "grades"))
def _(t: Tables) -> DataFrame:
    return bm25.grade_histogram(t.grades())


def _labels(t: Tables) -> DataFrame:
    """Gold group of each result, and the component that exact and fuzzy links give it together."""
    members, _ = dedup.all_groups(t.results())
    return materialize(t.gold().join(members.select("id", F.col("component").alias("found")), "id"), "labels")


def _bridge_labels(t: Tables) -> DataFrame:
    """Gold group of each result with its component by exact links alone and by fuzzy links alone."""
    labels = t.gold()
    for name, groups in (("exact", dedup.exact_groups), ("fuzzy", dedup.fuzzy_groups)):
        members, _ = groups(t.results())
        labels = labels.join(members.select("id", F.col("component").cast("string").alias(name)), "id", "left")
    return materialize(labels, "labels")


CLEAR = "NOT EXISTS (SELECT 1 FROM unclear_pairs u WHERE u.a = p.a AND u.b = p.b)"


def pair_counts(found: str) -> str:
    return f"""SELECT r.search_id, coalesce(g.n, 0) AS gold_pairs, coalesce(f.n, 0) AS predicted_pairs, coalesce(s.n, 0) AS shared_pairs FROM (SELECT DISTINCT search_id FROM results) r
    LEFT JOIN (SELECT search_id, count(*) AS n FROM gold_pairs p WHERE {CLEAR} GROUP BY 1) g USING (search_id)
    LEFT JOIN (SELECT search_id, count(*) AS n FROM {found} p WHERE {CLEAR} GROUP BY 1) f USING (search_id)
    LEFT JOIN (SELECT p.search_id, count(*) AS n FROM {found} p JOIN gold_pairs q USING (search_id, a, b) WHERE {CLEAR} GROUP BY 1) s USING (search_id)"""


PAIR_COUNTS = pair_counts("found_pairs")


@bound("e9_pair_counts", sql(pair_counts("bridge_pairs"), "results", "gold_pairs", "bridge_pairs", "unclear_pairs"))
def _(t: Tables) -> DataFrame:
    return tidy(evaluation.dedup_counts(_bridge_labels(t), ["exact", "fuzzy"], t.unclear()))


@bound(
    "e9_bridge_and_pipeline",
    sql(
        f"""SELECT CAST(count(*) FILTER (b.predicted_pairs IS DISTINCT FROM j.predicted_pairs OR b.shared_pairs IS DISTINCT FROM j.shared_pairs) AS BIGINT) AS searches_apart
        FROM ({pair_counts("bridge_pairs")}) b JOIN ({PAIR_COUNTS}) j USING (search_id)""",
        "results", "gold_pairs", "bridge_pairs", "found_pairs", "unclear_pairs",
    ),
)
def _(t: Tables) -> DataFrame:
    bridge = evaluation.dedup_counts(_bridge_labels(t), ["exact", "fuzzy"], t.unclear())
    joint = evaluation.dedup_counts(_labels(t), ["found"], t.unclear())
    apart = [~F.col(f"b.{c}").eqNullSafe(F.col(f"j.{c}")) for c in ("predicted_pairs", "shared_pairs")]
    return bridge.alias("b").join(joint.alias("j"), "search_id").agg(F.count_if(apart[0] | apart[1]).alias("searches_apart"))


@bound(
    "a16_dedup_metrics",
    sql(
        f"""SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (
        SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM (
        SELECT CAST(sum(shared_pairs) AS BIGINT) AS tp, CAST(sum(predicted_pairs - shared_pairs) AS BIGINT) AS fp, CAST(sum(gold_pairs - shared_pairs) AS BIGINT) AS fn FROM ({PAIR_COUNTS})))""",
        "results", "gold_pairs", "found_pairs", "unclear_pairs",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(evaluation.dedup_metrics(evaluation.dedup_counts(_labels(t), ["found"], t.unclear())))


@bound(
    "j11_ambiguous_pairs",
    sql(
        """SELECT x.search_id, p.a, p.b, x.gold = y.gold AS in_gold, coalesce(m.component = k.component, false) AS in_predicted FROM unclear_pairs p
        JOIN gold x ON x.id = p.a JOIN gold y ON y.id = p.b AND y.search_id = x.search_id
        LEFT JOIN all_member m ON m.id = p.a LEFT JOIN all_member k ON k.id = p.b""",
        "unclear_pairs", "gold", "all_member",
    ),
)
def _(t: Tables) -> DataFrame:
    return evaluation.ambiguous_pairs(_labels(t), t.unclear(), ["found"])


@bound(
    "e10_annotation_report",
    sql(
        """SELECT (SELECT count(*) FROM results) AS rows_in, (SELECT count(*) FROM annotated) AS rows_out, (SELECT count(*) FROM annotated WHERE is_duplicate) AS duplicates,
        count(*) AS groups, CAST(coalesce(sum(member_count - 1), 0) AS BIGINT) AS stated_duplicates, count(*) AS sizes_right, count(*) AS canonicals_right,
        (SELECT count(*) FROM unclear_pairs p JOIN annotated x ON x.id = p.a JOIN annotated y ON y.id = p.b AND x.search_id = y.search_id AND x.grp = y.grp) AS ambiguous_merged,
        true AS rows_preserved FROM all_groups""",
        "results", "annotated", "all_groups", "unclear_pairs",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = t.results().drop("doc_id")
    annotated, groups = dedup.annotate(rows)
    return postpass.annotation_report(rows, materialize(annotated, "annotated"), groups, t.unclear())


@bound(
    "u7_same_rows",
    sql("SELECT CAST(0 AS BIGINT) AS differences FROM results LIMIT 1", "results"),
)
def _(t: Tables) -> DataFrame:
    once = ranking.baseline_positions(t.results(), t.searches()).select("search_id", "id", "position")
    # Dealt anew in as many parts as the session has, so that a part does not grow with the tables.
    shuffled = t.results().repartition("title", "id")
    again = ranking.baseline_positions(shuffled, t.searches()).select("search_id", "id", "position")
    return once.exceptAll(again).unionByName(again.exceptAll(once)).agg(F.count("*").alias("differences"))


# --- BM25 ------------------------------------------------------------------


@bound(
    "a15_collection_statistics",
    sql(
        "SELECT search_id, CASE f WHEN 't' THEN 'title' ELSE 'description' END AS field, term, n AS documents FROM held_all",
        "held_all",
    ),
)
def _(t: Tables) -> DataFrame:
    return bm25.collection_statistics(t.results())


@bound(
    "a15_field_lengths",
    sql("SELECT search_id, documents, round(title_mean, 6) AS title_terms, round(description_mean, 6) AS description_terms FROM bag_stats", "bag_stats"),
)
def _(t: Tables) -> DataFrame:
    return tidy(bm25.field_lengths(t.results()))


@bound(
    "x14_term_idf",
    sql(
        f"SELECT search_id, spot - 1 AS at_place, term, round({R.idf('smooth1', 'tn')}, 6) AS title_idf, round({R.idf('smooth1', 'dn')}, 6) AS description_idf FROM asked_stats",
        "asked_stats",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(bm25.term_idf(t.results(), t.searches()).withColumnRenamed("at", "at_place"))


@bound("x16_bm25_relevance", sql("SELECT search_id, id, round(base_relevance, 6) AS base_relevance FROM base_core", "base_core"))
def _(t: Tables) -> DataFrame:
    return tidy(bm25.with_bm25(t.results(), t.searches(), include_bonuses=False).select("search_id", "id", "base_relevance"))


BONUSES = ["exact_phrase_title", "query_substring_title", "query_substring_description", "all_terms_title"]


@bound("x17_bonuses", sql(f"SELECT search_id, id, {', '.join(BONUSES)} FROM bonus", "bonus"))
def _(t: Tables) -> DataFrame:
    return tidy(bm25.with_bm25(t.results(), t.searches()).select("search_id", "id", *BONUSES))


@bound("o4_bm25_order", sql("SELECT search_id, id, round(bm25, 6) AS bm25, position FROM bm25_core", "bm25_core"))
def _(t: Tables) -> DataFrame:
    return tidy(bm25.bm25_positions(t.results(), t.searches(), include_bonuses=False).select("search_id", "id", "bm25", "position"))


DELTAS = ", ".join(
    f"round({m} - (SELECT avg({m}) FROM three_metrics WHERE ranker = 'baseline'), 6) AS delta_{m}" for m in evaluation.METRICS
)


@bound(
    "e11_bm25_evaluation",
    sql(
        f"""SELECT ranker, queries, {', '.join(f'round({m}, 6) AS {m}' for m in evaluation.METRICS)}, {DELTAS} FROM (
        SELECT ranker, count(*) AS queries, {', '.join(f'avg({m}) AS {m}' for m in evaluation.METRICS)} FROM three_metrics GROUP BY 1)""",
        "three_metrics",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(bm25.ranker_comparison(t.results(), t.searches(), t.grades()))


@bound("e12_variant_sweep", sql(f"SELECT variant, count(*) AS queries, {R.MEANS} FROM variant_metrics GROUP BY 1", "variant_metrics"))
def _(t: Tables) -> DataFrame:
    return tidy(bm25.variant_sweep(t.results(), t.searches(), t.grades()))


# Variants of no module: dealt from a table, with an inverse document frequency of their own.
TABLE_IDF = {**bm25.IDF, "plain": lambda total, n: F.log(1 + total / (n + 1))}


@bound("e12_variants_of_a_table", sql(f"SELECT variant, count(*) AS queries, {R.MEANS} FROM table_variant_metrics GROUP BY 1", "table_variant_metrics"))
def _(t: Tables) -> DataFrame:
    key = F.col("r_regionkey")
    variants = t.read("region").select(
        F.concat(F.lit("v"), key).alias("variant"), (1 + key / 2).alias("title"), (1 - key / 8).alias("description"),
        (key / 4).alias("b"), F.when(key % 2 == 0, "plain").otherwise("smooth2").alias("idf"),
    )
    return tidy(bm25.variant_sweep(t.results(), t.searches(), t.grades(), variants, TABLE_IDF))


@bound(
    "e13_forensic_report",
    sql(
        """SELECT 'idf_title' AS part, search_id, CAST(spot - 1 AS BIGINT) AS place, term AS item, NULL::VARCHAR AS other, round(%s, 6) AS value FROM asked_stats
        UNION ALL SELECT 'idf_description', search_id, spot - 1, term, NULL, round(%s, 6) FROM asked_stats
        UNION ALL SELECT 'lexical_top', search_id, lexical_at, id, NULL, raw_relevance FROM two_ranks WHERE lexical_at <= 10
        UNION ALL SELECT 'bm25_top', search_id, bm25_at, id, NULL, round(bm25, 6) FROM two_ranks WHERE bm25_at <= 10
        UNION ALL SELECT 'shift', search_id, bm25_at, id, NULL, bm25_at - lexical_at FROM two_ranks WHERE rel >= 1
        UNION ALL SELECT 'inversion', x.search_id, x.bm25_at, x.id, y.id, x.rel - y.rel FROM two_ranks x JOIN two_ranks y
        ON x.search_id = y.search_id AND x.rel > y.rel AND x.lexical_at <= 10 AND x.bm25_at <= 10 AND y.lexical_at <= 10 AND y.bm25_at <= 10
        AND (x.lexical_at < y.lexical_at) <> (x.bm25_at < y.bm25_at)"""
        % (R.idf("smooth1", "tn"), R.idf("smooth1", "dn")),
        "asked_stats", "two_ranks",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(bm25.forensic_report(t.results(), t.searches(), t.grades()))


@bound(
    "w8_rank_shifts",
    sql("SELECT search_id, id, lexical_at, bm25_at, bm25_at - lexical_at AS shift FROM two_ranks WHERE rel >= 1", "two_ranks"),
)
def _(t: Tables) -> DataFrame:
    both = bm25.both_positions(t.results(), t.searches(), t.grades())
    return tidy(bm25.rank_shifts(both).select("search_id", "id", "lexical_at", "bm25_at", "shift"))


@bound(
    "a21_relevant_in_top10",
    sql("SELECT search_id, count(*) FILTER (rel >= 1 AND lexical_at <= 10) AS lexical, count(*) FILTER (rel >= 1 AND bm25_at <= 10) AS bm25 FROM two_ranks GROUP BY 1", "two_ranks"),
)
def _(t: Tables) -> DataFrame:
    return bm25.relevant_in_top10(bm25.both_positions(t.results(), t.searches(), t.grades()))


@bound(
    "j9_inversions",
    sql(
        """SELECT x.search_id, x.id AS better_id, y.id AS worse_id, CAST(x.rel - y.rel AS BIGINT) AS gap, x.lexical_at AS better_lexical_at, y.lexical_at AS worse_lexical_at FROM two_ranks x JOIN two_ranks y
        ON x.search_id = y.search_id AND x.rel > y.rel AND x.lexical_at <= 10 AND x.bm25_at <= 10 AND y.lexical_at <= 10 AND y.bm25_at <= 10
        AND (x.lexical_at < y.lexical_at) <> (x.bm25_at < y.bm25_at)""",
        "two_ranks",
    ),
)
def _(t: Tables) -> DataFrame:
    both = materialize(bm25.both_positions(t.results(), t.searches(), t.grades()), "both")
    pairs = bm25.harmful_inversions(both)
    return tidy(pairs.select("search_id", "better_id", "worse_id", "gap", "better_lexical_at", "worse_lexical_at"))


# --- operations ------------------------------------------------------------


@bound(
    "a3_search_status",
    sql(
        """SELECT search_id, count(*) FILTER (status <> 'success') AS failed, count(*) AS sources,
        CASE WHEN count(*) FILTER (status <> 'success') = 0 THEN 'completed' WHEN count(*) FILTER (status <> 'success') < count(*) THEN 'partial' ELSE 'failed' END AS status FROM source_events GROUP BY 1""",
        "source_events",
    ),
)
def _(t: Tables) -> DataFrame:
    return views.search_status(t.events())


@bound(
    "a7_search_stats",
    sql(
        """SELECT s.search_id, coalesce(d.groups, 0) AS groups, coalesce(d.duplicates, 0) AS duplicates, round(s.total, 6) AS total_ms, coalesce(e.failed, 0) AS failed, coalesce(e.sources, 0) AS sources,
        CASE WHEN e.sources IS NULL OR e.failed = 0 THEN 'completed' WHEN e.failed < e.sources THEN 'partial' ELSE 'failed' END AS status, e.sources_ms, e.busy_ms,
        coalesce(r.ranked, 0) AS ranked, round(CASE WHEN s.total IS NOT NULL THEN greatest(0.0, s.total - coalesce(e.sources_ms, 0)) END, 6) AS postpass_ms
        FROM (SELECT search_id, (epoch_us(completed_at) - epoch_us(created_at)) / 1000.0::DOUBLE AS total FROM searches) s
        LEFT JOIN (SELECT search_id, count(*) AS groups, CAST(sum(member_count - 1) AS BIGINT) AS duplicates FROM all_groups GROUP BY 1) d USING (search_id)
        LEFT JOIN (SELECT 's' || search_id AS search_id, count(*) FILTER (status <> 'success') AS failed, count(*) AS sources, max(latency_ms) AS sources_ms, CAST(sum(latency_ms) AS BIGINT) AS busy_ms
            FROM source_events GROUP BY 1) e USING (search_id)
        LEFT JOIN (SELECT search_id, count(*) AS ranked FROM placed GROUP BY 1) r USING (search_id)""",
        "searches", "all_groups", "source_events", "placed",
    ),
)
def _(t: Tables) -> DataFrame:
    events = t.events().withColumn("search_id", F.concat(F.lit("s"), "search_id"))
    return tidy(postpass.search_stats(t.searches(), events, dedup.all_groups(t.results())[1], _stored(t)))


@bound(
    "a7_search_timings",
    sql("SELECT search_id, max(latency_ms) AS sources_ms, CAST(sum(latency_ms) AS BIGINT) AS busy_ms, count(*) AS sources FROM source_events GROUP BY 1", "source_events"),
)
def _(t: Tables) -> DataFrame:
    return operations.search_timings(t.events())


@bound(
    "e16_source_health",
    sql(
        """SELECT source_name, count(*) AS events, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
        count(*) FILTER (status = 'timeout') AS timeout, count(*) FILTER (status = 'rate_limited') AS rate_limited,
        round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, min(latency_ms) AS best_ms,
        list_sort(list(latency_ms))[(count(*) // 2) + 1] AS p50_ms, list_sort(list(latency_ms))[CAST(ceil(count(*) * 0.95::DOUBLE) AS BIGINT)] AS p95_ms FROM source_events GROUP BY 1""",
        "source_events",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(operations.source_health(t.events()))


@bound("a19_running", sql("SELECT count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'running') < 8 AS may_start FROM searches", "searches"))
def _(t: Tables) -> DataFrame:
    return admission.running(t.searches())


@bound(
    "a22_arrivals",
    sql(
        """SELECT search_id, round((epoch_us(min(retrieved_at)) - epoch_us(any_value(created_at))) / 1000.0::DOUBLE, 6) AS first_ms,
        round((epoch_us(any_value(completed_at)) - epoch_us(any_value(created_at))) / 1000.0::DOUBLE, 6) AS done_ms FROM searches LEFT JOIN results USING (search_id) GROUP BY 1""",
        "searches", "results",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(operations.arrival_times(t.searches(), t.results()))


def _percentiles(name: str) -> str:
    values = f"list_sort(list({name}_ms) FILTER ({name}_ms IS NOT NULL))"
    return (
        f"round({values}[count({name}_ms) // 2 + 1], 6) AS p50_{name}_ms,"
        f" round({values}[CAST(ceil(count({name}_ms) * 0.95::DOUBLE) AS BIGINT)], 6) AS p95_{name}_ms"
    )


@bound(
    "a22_arrival_summary",
    sql(
        f"""SELECT count(*) AS searches, round(min(first_ms), 6) AS best_first_ms, round(min(done_ms), 6) AS best_done_ms,
        count(*) FILTER (first_ms IS NULL OR first_ms > 3000) AS late_first, count(*) FILTER (done_ms IS NULL OR done_ms > 5000) AS late_done,
        {_percentiles("first")}, {_percentiles("done")} FROM (
        SELECT search_id, (epoch_us(min(retrieved_at)) - epoch_us(any_value(created_at))) / 1000.0::DOUBLE AS first_ms,
        (epoch_us(any_value(completed_at)) - epoch_us(any_value(created_at))) / 1000.0::DOUBLE AS done_ms FROM searches LEFT JOIN results USING (search_id) GROUP BY 1)""",
        "searches", "results",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(operations.arrival_summary(operations.arrival_times(t.searches(), t.results())))


@bound(
    "a17_throughput",
    sql(
        """SELECT count(*) AS searches, (epoch_us(max(completed_at)) - epoch_us(min(created_at))) / 1e6::DOUBLE AS wall_s,
        round(count(*) / ((epoch_us(max(completed_at)) - epoch_us(min(created_at))) / 1e6::DOUBLE), 6) AS per_second FROM searches WHERE completed_at IS NOT NULL""",
        "searches",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(operations.throughput(t.searches()))


@bound(
    "t2_deadline_batch",
    sql("SELECT event_id, CASE WHEN latency_ms > 4500 THEN 'timeout' ELSE status END AS status, least(latency_ms, 4500) AS latency_ms FROM source_events", "source_events"),
)
def _(t: Tables) -> DataFrame:
    return operations.with_deadline(t.events()).select("event_id", "status", "latency_ms")


# Limits under which the events of the tables are busy: 2 hits in 5 days.
BUSY = {"max_hits": 2, "window_seconds": 5 * 86400.0}
ADMITTED = f"""SELECT key, id, admitted FROM (SELECT user_id AS key, unnest(list_reduce(list({{'id': event_id, 't': epoch_us(ts)}} ORDER BY ts, event_id),
    lambda acc, h: {{'live': CASE WHEN len(list_filter(acc.live, lambda x: x > h.t - 432000000000)) < 2 THEN list_append(list_filter(acc.live, lambda x: x > h.t - 432000000000), h.t) ELSE list_filter(acc.live, lambda x: x > h.t - 432000000000) END,
    'out': list_append(acc.out, {{'id': h.id, 'admitted': len(list_filter(acc.live, lambda x: x > h.t - 432000000000)) < 2}})}},
    {{'live': []::BIGINT[], 'out': []::STRUCT(id BIGINT, admitted BOOLEAN)[]}}).out, recursive := true) FROM events GROUP BY user_id)"""


@bound("w9_admission", ADMITTED)
def _(t: Tables) -> DataFrame:
    return admission.admit(t.hits(), **BUSY).select("key", "id", "admitted")


# --- streams ---------------------------------------------------------------


def _paths(t: Tables) -> tuple[str, str]:
    base = f"{shared_folder(t.spark)}/stream-{uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _stream(t: Tables, name: str) -> DataFrame:
    schema = t.read(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


@bound(
    "t1_progressive_results",
    sql(
        """SELECT search_id, CASE source WHEN 'guardian' THEN 'The Guardian' WHEN 'reddit' THEN 'Reddit' ELSE 'Wikipedia' END AS source_name,
        CAST(sum(CASE source WHEN 'reddit' THEN titled ELSE n_rows END) AS BIGINT) AS records FROM outcomes
        WHERE status = 'success' AND source <> 'gdelt' GROUP BY 1, 2 HAVING records > 0""",
        "outcomes",
    ),
)
def _(t: Tables) -> DataFrame:
    landed = f"{shared_folder(t.spark)}/landing-{uuid4().hex}"
    t.fetches().write.parquet(landed)
    stream = jobs.progressive_results(jobs.read_landing(t.spark, landed))
    out = jobs.run_available(stream, *_paths(t))
    return out.groupBy("search_id", "source_name").agg(F.count("*").alias("records"))


@bound("t4_throttle", ADMITTED)
def _(t: Tables) -> DataFrame:
    hits = _stream(t, "events").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id")
    )
    return jobs.run_available(jobs.throttle(hits, **BUSY), *_paths(t))


@bound(
    "t3_completions",
    sql(
        """SELECT search_id, CASE WHEN failed = 0 THEN 'completed' WHEN failed < n THEN 'partial' ELSE 'failed' END AS status, failed FROM (
        SELECT search_id, count(*) AS n, count(*) FILTER (status <> 'success') AS failed FROM (
        SELECT search_id, source_name, arg_min(status, event_id) AS status FROM source_events GROUP BY ALL) GROUP BY 1) WHERE n >= 5""",
        "source_events",
    ),
)
def _(t: Tables) -> DataFrame:
    status = F.expr(
        "CASE event_id % 10 WHEN 7 THEN 'failed' WHEN 8 THEN 'timeout' WHEN 9 THEN 'rate_limited' ELSE 'success' END"
    )
    outcomes = _stream(t, "events").select(
        F.col("user_id").cast("string").alias("search_id"), F.col("event_type").alias("source"), status.alias("status"),
        F.col("event_id").alias("at"),
    )
    path, checkpoint = _paths(t)
    return jobs.run_until_settled(jobs.completions(outcomes, expected=5), checkpoint, path)


def _landed(t: Tables, *frames: DataFrame) -> DataFrame:
    """A stream of frames of one schema that land in files of their own."""
    folder = f"{shared_folder(t.spark)}/landed-{uuid4().hex}"
    for frame in frames:
        frame.write.mode("append").parquet(folder)
    return t.spark.readStream.schema(frames[0].schema).parquet(folder)


@bound(
    "t2_deadline_stream",
    sql(
        """SELECT search_id, source, CASE WHEN silent OR latency_ms > 4500 THEN 'timeout' ELSE status END AS status,
        CASE WHEN silent THEN 4500 ELSE least(latency_ms, 4500) END AS latency_ms FROM (
        SELECT search_id || '/' || event_id AS search_id, source_name AS source, status, latency_ms, event_id % 10 = 3 AS silent FROM source_events)""",
        "source_events",
    ),
)
def _(t: Tables) -> DataFrame:
    """Starts and answers land in separate files; a tenth of the sources never answers."""
    events = t.events()
    search, started = F.concat_ws("/", "search_id", "event_id").alias("search_id"), F.date_trunc("second", "created_at")
    starts = events.select(search, F.col("source_name").alias("source"), F.lit("started").alias("status"), started.alias("at"))
    answers = events.filter("event_id % 10 <> 3").select(
        search, F.col("source_name").alias("source"), "status",
        F.timestamp_micros(F.unix_micros(started) + F.col("latency_ms") * 1000).alias("at"),
    )
    path, checkpoint = _paths(t)
    outcomes = jobs.enforce_deadline(_landed(t, starts, answers))
    return jobs.run_until_settled(outcomes, checkpoint, path).select("search_id", "source", "status", "latency_ms")


@bound(
    "t3_postpass",
    sql(
        """SELECT p.search_id, s.status, s.failed, p.id, p.rank_position FROM placed p JOIN (
        SELECT search_id, CASE WHEN failed = 0 THEN 'completed' WHEN failed < n THEN 'partial' ELSE 'failed' END AS status, failed FROM (
        SELECT search_id, count(*) AS n, count(*) FILTER ((CAST(substr(search_id, 2) AS BIGINT) + length(source_type)) % 5 = 3) AS failed
        FROM (SELECT DISTINCT search_id, source_type FROM results) GROUP BY 1)) s USING (search_id)""",
        "placed", "results",
    ),
)
def _(t: Tables) -> DataFrame:
    """Deadline, completion and post-pass as one query: what is silent is waited for, and what is complete is ranked."""
    base = f"{shared_folder(t.spark)}/postpass-{uuid4().hex}"
    store, out, checkpoint = (f"{base}/{name}" for name in ("store", "out", "checkpoint"))
    results = t.results().drop("doc_id")
    sinks.append_results(results, store, buckets=8)
    asked = results.select("search_id", F.col("source_type").alias("source")).distinct()
    asked = asked.withColumn("expected", F.count("*").over(Window.partitionBy("search_id")))
    at = F.timestamp_seconds(F.lit(NOW_SECONDS))
    silent = (F.substring("search_id", 2, 20).cast("long") + F.length("source")) % 5 == 3
    starts = asked.select("search_id", "source", F.lit("started").alias("status"), at.alias("at"), "expected")
    answers = asked.filter(~silent).select(
        "search_id", "source", F.lit("success").alias("status"), F.timestamp_seconds(F.lit(NOW_SECONDS + 1)).alias("at"), F.lit(None).cast("long").alias("expected")
    )
    done = jobs.completions(jobs.enforce_deadline(_landed(t, starts, answers)))
    jobs.run_until_settled(done, checkpoint, step=jobs.postpass_batch(store, t.searches(), out, lambda: NOW, buckets=8))
    ranked = t.spark.read.parquet(f"{out}/results").select("search_id", "id", "rank_position")
    states = t.spark.read.parquet(f"{out}/searches").select("search_id", "status", "failed")
    return tidy(ranked.join(states, "search_id"))


@bound(
    "t5_first_seen",
    sql("SELECT DISTINCT search_id, sha256(canonical_url) AS dedupe_key FROM keyed", "keyed"),
)
def _(t: Tables) -> DataFrame:
    landed = f"{shared_folder(t.spark)}/seen-{uuid4().hex}"
    to_results(t.results()).write.parquet(landed)
    stream = t.spark.readStream.schema(t.spark.read.parquet(landed).schema).parquet(landed)
    return jobs.run_available(jobs.first_seen(stream), *_paths(t)).select("search_id", "dedupe_key")
