"""The benchmark tables seen as searches, results, events and labels.

One search per benchmark item; documents are dealt to the searches in turn, so
both grow with the data. Each view here has a twin in ``reference.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resultloom.functions.text import tokens

NOW = "2024-01-31 00:00:00"
NOW_SECONDS = 1706659200


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        self.spark, self.folder = spark, folder
        self._searches: int | None = None

    def read(self, name: str) -> DataFrame:
        """A table. Text in fewer splits than cores is spread out before it is parsed.

        One row group is one task, however many cores wait; a table of many splits
        is left as it is.
        """
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        key = {"documents": "doc_id", "pages": "page_id"}.get(name)
        cores = self.spark.sparkContext.defaultParallelism
        if key and table.rdd.getNumPartitions() < cores:
            table = table.repartition(cores, key)
        return table

    @property
    def search_count(self) -> int:
        """Number of searches, from the Parquet footers."""
        if self._searches is None:
            self._searches = self.read("benchmark").count()
        return self._searches

    def results(self) -> DataFrame:
        n = self.search_count
        first_line = "split_part(text, '\\n', 1)"
        return self.read("documents").selectExpr(
            f"concat('s', doc_id % {n}) AS search_id",
            "cast(doc_id AS string) AS id",
            "CASE doc_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'social' ELSE 'reference' END AS source_type",
            "CASE source WHEN 'src0' THEN 'The Guardian' WHEN 'src1' THEN 'Wikipedia'"
            " WHEN 'src2' THEN 'Global Wire' ELSE source END AS source_name",
            f"{first_line} AS title",
            f"nullif(substring(text, length({first_line}) + 2), '') AS description",
            f"concat('https://n.example/', lang, '/', cast(floor(doc_id / {2 * n}) AS bigint),"
            f" CASE WHEN floor(doc_id / {n}) % 2 = 1 THEN '?utm_source=x' ELSE '' END) AS url",
            "CASE WHEN doc_id % 5 = 0 THEN '[deleted]' ELSE concat('author', doc_id % 17) END AS author",
            f"CASE WHEN doc_id % 7 <> 0 THEN timestamp_seconds({NOW_SECONDS} - (n_chars % 2000) * 3600) END"
            " AS published_at",
            f"timestamp_seconds({NOW_SECONDS} - doc_id % 600) AS retrieved_at",
            "CASE WHEN doc_id % 11 <> 0 THEN lang END AS language",
            "doc_id",
        )

    def variants(self) -> DataFrame:
        """Each result, a copy with a publisher suffix a day later, and a reworded one 30 days later."""
        base = self.results().select(
            "search_id", "id", "source_type", "source_name", "title", "description", "url", "published_at"
        )
        words = F.split(F.col("title"), " ")
        reworded = F.concat_ws(
            " ", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.element_at(words, 1), F.lit("again")
        )
        forms = F.array(
            F.struct(F.lit("").alias("tag"), F.col("title").alias("title"), F.lit(0).alias("days")),
            F.struct(F.lit("b").alias("tag"), F.concat("title", F.lit(" — The Guardian")).alias("title"), F.lit(1).alias("days")),
            F.struct(F.lit("c").alias("tag"), reworded.alias("title"), F.lit(30).alias("days")),
        )
        return base.withColumn("form", F.explode(forms)).select(
            "search_id",
            F.concat("id", "form.tag").alias("id"),
            "source_type",
            "source_name",
            F.col("form.title").alias("title"),
            "description",
            F.concat("url", F.when(F.col("form.tag") != "", F.concat(F.lit("/"), "id", "form.tag")).otherwise("")).alias("url"),
            F.timestamp_micros(F.unix_micros("published_at") + F.col("form.days") * 86_400_000_000).alias("published_at"),
        )

    def page_links(self) -> DataFrame:
        """Each page URL in five spellings, with title and language of the page."""
        url = F.col("url")
        has_query = url.contains("?")
        bare = F.regexp_replace(url, "#.*", "")
        host = F.regexp_extract(url, "^https?://([^/?#]+)", 1)
        port = F.when(url.startswith("https"), ":443").otherwise(":80")
        spellings = F.array(
            url,
            F.concat(bare, F.when(has_query, "&").otherwise("?"), F.lit("utm_medium=mail&gclid=1")),
            F.concat(bare, F.lit("#x")),
            F.replace(url, host, F.upper(host)),
            F.replace(url, host, F.concat(host, port)),
        )
        return self.read("pages").select(
            "page_id",
            F.posexplode(spellings).alias("spelling", "url"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("language"),
        )

    def searches(self) -> DataFrame:
        return self.read("benchmark").select(
            F.concat(F.lit("s"), "item_id").alias("search_id"),
            F.col("text").alias("query"),
            F.timestamp_seconds(F.lit(NOW_SECONDS) - 86400 + F.col("item_id") * 60).alias("created_at"),
            F.expr(
                f"CASE WHEN item_id % 5 <> 0 THEN timestamp_seconds({NOW_SECONDS} - 86400 + item_id * 60"
                " + item_id % 9) END"
            ).alias("completed_at"),
            F.expr("CASE WHEN item_id % 5 = 0 THEN 'running' ELSE 'completed' END").alias("status"),
        )

    def grades(self) -> DataFrame:
        """One label per result; results without one are grade 0."""
        rel = F.expr("CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END")
        labels = self.read("labels").select(F.col("doc_id").cast("string").alias("id"), rel.alias("rel"))
        return (
            self.results().select("search_id", "id").join(labels, "id", "left").na.fill(0, ["rel"])
        )

    def events(self) -> DataFrame:
        status = F.expr(
            "CASE event_id % 10 WHEN 7 THEN 'failed' WHEN 8 THEN 'timeout' WHEN 9 THEN 'rate_limited'"
            " ELSE 'success' END"
        )
        return self.read("events").select(
            F.col("user_id").cast("string").alias("search_id"),
            F.col("event_type").alias("source_name"),
            status.alias("status"),
            F.floor(F.col("value") * 100).cast("long").alias("latency_ms"),
            (F.col("event_id") % 13).alias("result_count"),
            F.when(status != "success", status).alias("error_type"),
            F.col("ts").cast("timestamp").alias("created_at"),
            "event_id",
        )

    def hits(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id")
        )

    def gold(self) -> DataFrame:
        """Results of one search with the same title letters are gold duplicates."""
        letters = F.array_join(tokens(F.col("title")), " ")
        return self.results().select("search_id", "id", F.concat_ws("|", "search_id", letters).alias("gold"))

    def unclear(self) -> DataFrame:
        """Pairs of a toxic document and the next one of its search."""
        return self.read("labels").filter("toxic = 1").select(
            F.col("doc_id").cast("string").alias("a"),
            (F.col("doc_id") + self.search_count).cast("string").alias("b"),
        )

    def payloads(self) -> DataFrame:
        """Results as raw payloads of each source kind, at most ten records in each."""
        n = self.search_count
        rows = self.results().withColumn("page", F.floor(F.col("doc_id") / (10 * n)))
        iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        text = F.coalesce("description", F.lit(""))
        news = F.struct(
            F.col("title").alias("webTitle"), F.col("url").alias("webUrl"), iso.alias("webPublicationDate"),
            F.struct(text.alias("trailText"), F.col("author").alias("byline")).alias("fields"),
        )
        post = F.struct(
            F.lit("t3").alias("kind"),
            F.struct(
                "id", F.col("language").alias("subreddit"), "title", text.alias("selftext"), "author",
                F.unix_timestamp("published_at").alias("created_utc"), F.lit("hidden").alias("modhash_token"),
            ).alias("data"),
        )
        article = F.struct("url", "title", "language", F.lit("20240101000000").alias("seendate"))
        entry = F.struct(
            F.col("id").alias("key"), F.struct(F.replace("title", F.lit(" "), F.lit("_")).alias("title"), text.alias("extract")).alias("value")
        )
        packed = rows.groupBy("search_id", "page").agg(
            F.collect_list(news).alias("news"),
            F.collect_list(post).alias("posts"),
            F.collect_list(article).alias("articles"),
            F.collect_list(entry).alias("entries"),
        )
        shapes = {
            "guardian": F.struct(F.struct(F.lit("ok").alias("status"), F.col("news").alias("results")).alias("response")),
            "reddit": F.struct(F.struct(F.col("posts").alias("children")).alias("data")),
            "wikipedia": F.struct(F.struct(F.map_from_entries("entries").alias("pages")).alias("query")),
            "gdelt": F.struct("articles"),
        }
        bodies = F.array(
            *[F.struct(F.lit(n).alias("source"), F.to_json(shape).alias("body")) for n, shape in shapes.items()]
        )
        return packed.select("search_id", "page", F.explode(bodies).alias("b")).select(
            "search_id",
            F.col("b.source").alias("source"),
            F.timestamp_seconds(F.lit(NOW_SECONDS) + F.col("page")).alias("fetched_at"),
            F.lit(200).alias("http_status"),
            (F.col("page") % 5000).alias("latency_ms"),
            F.col("b.body").alias("body"),
        )

    def fetches(self) -> DataFrame:
        """Payloads among which some failed, by document page and source."""
        spread = F.expr("pmod(unix_seconds(fetched_at) + length(source) + cast(substring(search_id, 2) AS bigint), 7)")
        return self.payloads().withColumn("_h", spread).select(
            "search_id", "source", "fetched_at",
            F.expr("CASE _h WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN NULL ELSE 200 END").alias("http_status"),
            F.expr("CASE _h WHEN 4 THEN 9000 ELSE 120 END").cast("long").alias("latency_ms"),
            F.expr("CASE _h WHEN 5 THEN '<html>' WHEN 6 THEN '{\"other\": 1}' ELSE body END").alias("body"),
        )
