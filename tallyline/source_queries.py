"""Registered queries of sources: workbooks, feeds, listings, pages; with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.registry import query, table
from tallyline.sources import cursors, feed, listings, xlsx
from tallyline.sources.scratch import folder
from tallyline.streaming import replay


@query("""WITH x AS (SELECT c_custkey // 50 AS book, c_custkey % 50 AS pos, c_name, c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 9 <> 4)
SELECT book::VARCHAR AS file_id, (pos % 2)::INT AS tab_index, (pos // 2)::INT AS row_number, array_to_string(CASE WHEN c_custkey % 7 = 3 THEN [c_name, c_custkey::VARCHAR] ELSE [c_name, c_custkey::VARCHAR, c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END] END, '|') AS cells,
  NULL::BOOLEAN AS read_complete FROM x
UNION ALL SELECT DISTINCT book::VARCHAR, t::INT, NULL, NULL, true FROM x, range(2) r(t)""")
def workbook_source(spark, sf_dir):
    """Workbooks of at most 50 customers in two tabs, some rows blank, some cells too; read back row by row."""
    chunks = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("book")).agg(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).alias("rows"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books = []
            for rows in batch.column(1).to_pylist():
                tabs: list[dict] = [{}, {}]
                for r in rows:
                    k = r["c_custkey"]
                    blank = k % 7 == 3
                    cells = [r["c_name"], k, None if blank else r["c_mktsegment"], " " if blank else r["c_nationkey"] % 2 == 0]
                    tabs[k % 50 % 2][k % 50 // 2] = [] if k % 9 == 4 else cells
                books.append(xlsx.write_workbook([(f"Tab {i}", [t.get(j, []) for j in range(max(t, default=-1) + 1)]) for i, t in enumerate(tabs)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(books, pa.binary())], ["book", "content"])

    rows = xlsx.workbook_rows(chunks.mapInArrow(write, "book long, content binary"), "book")
    return rows.select("file_id", "tab_index", "row_number", F.array_join("cells", "|").alias("cells"), "read_complete")


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_name, c_acctbal, c_custkey // 40 AS book FROM customer)
SELECT book::VARCHAR AS file_id, (3 + k % 40)::INT AS row, 1::INT AS col, CASE k % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'bool' WHEN 3 THEN 'error' WHEN 4 THEN 'unknown' ELSE 'empty' END AS kind,
  CASE k % 6 WHEN 0 THEN k::VARCHAR WHEN 1 THEN c_name WHEN 2 THEN (n % 2 = 0)::VARCHAR WHEN 3 THEN 'REF' WHEN 4 THEN '{"imageValue":' || k || '}' END AS value FROM c
UNION ALL SELECT book::VARCHAR, (3 + k % 40)::INT, 2, 'string', 'x"' || n FROM c""")
def workbook_cells(spark, sf_dir):
    """Cells of workbooks in JSON: an effective value of a branch that nobody knew keeps its JSON."""
    k = F.col("c_custkey")
    value = (
        F.when(k % 6 == 0, F.concat(F.lit('{"numberValue":'), k.cast("string"), F.lit("}"))).when(k % 6 == 1, F.to_json(F.struct(F.col("c_name").alias("stringValue"))))
        .when(k % 6 == 2, F.to_json(F.struct((F.col("c_nationkey") % 2 == 0).alias("boolValue")))).when(k % 6 == 3, F.lit('{"errorValue":{"type":"REF","message":"lost"}}'))
        .when(k % 6 == 4, F.concat(F.lit('{"imageValue":'), k.cast("string"), F.lit("}"))).otherwise(F.lit("null"))
    )
    second = F.to_json(F.struct(F.concat(F.lit('x"'), F.col("c_nationkey").cast("string")).alias("stringValue")))
    row = F.concat(F.lit('{"values":[{"effectiveValue":'), value, F.lit('},{"effectiveValue":'), second, F.lit(',"formattedValue":"f"}]}'))
    rows = table(spark, sf_dir, "customer").select(F.floor(k / 40).cast("string").alias("book"), (k % 40).cast("int").alias("at"), row.alias("row"))
    parts = rows.select("book", F.concat(F.lit('{"startRow":'), (F.col("at") + 3).cast("string"), F.lit(',"startColumn":1,"rowData":['), F.col("row"), F.lit("]}")).alias("part"))
    books = parts.groupBy("book").agg(F.array_join(F.collect_list("part"), ",").alias("data"))
    json = F.concat(F.lit('{"spreadsheetId":"'), F.col("book"), F.lit('","sheets":[{"properties":{"sheetId":7,"title":"T"},"data":['), F.col("data"), F.lit("]}]}"))
    return listings.variant_cells(books.select(json.alias("json")), "json").select("file_id", "row", "col", "kind", "value")


@query("""SELECT n.n_name AS range, count(c_custkey) AS rows, sum(c_custkey)::BIGINT AS total, false AS complete, '''NATION_17''|''NATION_3''' AS missing
FROM nation n JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey NOT IN (3, 17) GROUP BY n.n_name""")
def batched_ranges(spark, sf_dir):
    """A batch read of a range for each nation, of which two aren't answered: the read is not complete and says which."""
    names = sorted(r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect())
    asked = [x for batch in listings.range_batches(names, 10) for x in batch]
    c = table(spark, sf_dir, "customer").where(~F.col("c_nationkey").isin(3, 17)).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    answers = c.groupBy(F.concat(F.lit("'"), "n_name", F.lit("'")).alias("range")).agg(F.collect_list(F.array("c_name", F.col("c_custkey").cast("string"))).alias("values"))
    read = listings.range_rows(answers, asked)
    rows = read.rows.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.get("cells", 1).cast("bigint")).alias("total"))
    return rows.select(F.replace("range", F.lit("'"), F.lit("")).alias("range"), "rows", "total", F.lit(read.complete).alias("complete"), F.lit("|".join(sorted(read.reasons))).alias("missing"))


#: Pages of each subject of the feed in the query below, at least, and changes of a page on average, at most.
PAGES, PAGE_CHANGES = 6, 20_000


def write_feed(changes: DataFrame, base: str, pages: int) -> None:
    """Pages of changes (subject, page, change fields) as JSON lines under ``base/pages``, their tokens under ``base/tokens``.

    A page is a file that is written row by row, and one without changes has its token, too.
    """
    token = lambda c: F.concat(F.lit("t"), c.cast("string"))
    changes.withColumn("token", token(F.col("page"))).drop("page").repartition("subject", "token").write.partitionBy("subject", "token").json(f"{base}/pages")
    full = changes.groupBy("subject", "page").agg(F.count(F.lit(1)).alias("n"))
    every = changes.select("subject").distinct().crossJoin(changes.sparkSession.range(pages).select(F.col("id").alias("page")))
    after = token(F.col("page") + 1)
    heads = every.join(full, ["subject", "page"], "left").select(
        "subject", token(F.col("page")).alias("token"), F.coalesce("n", F.lit(0)).alias("changes"),
        F.when(F.col("page") < pages - 1, after).alias("nextPageToken"), F.when(F.col("page") == pages - 1, after).alias("newStartPageToken"),
    )
    heads.repartition("subject").write.partitionBy("subject").json(f"{base}/tokens")


@query("""WITH c AS (SELECT user_id, event_id, event_type, ts, event_id % 10 = 0 AS removed FROM events WHERE user_id IS NOT NULL
), last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(removed, (ts, event_id)) AS removed FROM c GROUP BY user_id)
SELECT user_id::VARCHAR AS id, event_type AS name, 'true' AS restarted FROM last WHERE NOT removed""")
def change_feed_replay(spark, sf_dir):
    """Events as a paged change feed of three subjects, streamed into a state; the stream is stopped after some pages and started anew."""
    base = f"{folder(spark)}/tallyline/feed-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").where(F.col("user_id").isNotNull())
    n, last = e.agg(F.count(F.lit(1)), F.coalesce(F.max("event_id"), F.lit(0))).first()
    count = max(PAGES, -(-n // (3 * PAGE_CHANGES)))
    page = F.greatest(F.least(F.floor(F.col("event_id") / (last + 1) * count), F.lit(count - 1)), F.lit(0)).cast("bigint")
    when = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("/"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    file = F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.lit(False).alias("trashed"))
    changes = e.select(
        F.concat(F.lit("s"), F.pmod("user_id", F.lit(3)).cast("string")).alias("subject"), page.alias("page"), F.lit("file").alias("changeType"), when.alias("time"),
        (F.col("event_id") % 10 == 0).alias("removed"), F.col("user_id").cast("string").alias("fileId"), file.alias("file"),
    )
    write_feed(changes, base, count)
    uri = base if "://" in base or base.startswith("file:") else f"file://{base}"
    run = -(-count * 2 // 3)
    source = feed.change_feed(feed.stored_pages(f"{uri}/pages"), {f"s{i}": "t0" for i in range(3)}, pages=run, name="tallyline_feed", tokens=feed.stored_tokens(f"{uri}/tokens"))
    spark.dataSource.register(source)
    sink = replay.ReplaySink(f"{base}-state", ["name"], buckets=64)
    runs = 0
    for _ in range(2):  # the first run takes two of three pages of each subject, the second goes on from its checkpoint
        replay.start_replay(spark.readStream.format("tallyline_feed").load(), sink, f"{base}-checkpoint").awaitTermination()
        runs = len(sink.versions(spark))
    state = sink.read(spark)
    state = spark.createDataFrame([], "id string, name string") if state is None else state
    return state.select("id", "name", F.lit(str(runs > 1).lower()).alias("restarted"))
