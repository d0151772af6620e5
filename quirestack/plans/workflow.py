"""Queries over state, jobs, evaluation and order; the SQL beside them is written from the definitions, not from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestack.functions import geometry as G
from quirestack.operators import evaluation as E
from quirestack.operators import order as O
from quirestack.operators import state as S
from quirestack.operators.jobs import job_log
from quirestack.operators.retrieval import greedy_match, nearest_vectors
from quirestack.plans.records import _TREES, p2_paths
from quirestack.session import table
from quirestack.streaming.queue import drain, job_stream, read_events

PAPER = ["paper_id", "generation"]
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """The event log as changes of one note for each user."""
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("kind"), "value", F.when(F.col("event_type") == "purchase", F.col("props")).alias("note"))


def note_state(spark: SparkSession, d: str) -> DataFrame:
    """The notes that are there after all changes."""
    j = S.judged(_changes(spark, d), ["user_id"], ["ts", "event_id"], "kind")
    return S.state_after(j, ["user_id"], ["ts", "event_id"], "kind", ["value", "note"])


def note_audit(spark: SparkSession, d: str) -> DataFrame:
    """What became of each change, denials included."""
    j = S.judged(_changes(spark, d), ["user_id"], ["ts", "event_id"], "kind")
    return S.audit(j, ["user_id"], ["ts", "event_id"], "kind").select("event_id", "user_id", "outcome", F.col("version").cast("long").alias("version"))


def notes_cascaded(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved blocks whose block is there, by owner, paper, generation and block."""
    r = table(spark, d, "retrieved_blocks").select("retrieval_no", "owner_id", *PAPER, "block_id").distinct()
    return S.cascade(r, table(spark, d, "blocks"), ["owner_id", *PAPER, "block_id"]).select("retrieval_no", "block_id")


def anchors_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Ends of relations that a foreign key on blocks would refuse."""
    r = table(spark, d, "relations").select(*PAPER, F.explode(F.array("from_block", "to_block")).alias("block_id")).distinct()
    return S.dangling(r, table(spark, d, "blocks"), [*PAPER, "block_id"])


def unique_sources(spark: SparkSession, d: str) -> DataFrame:
    """Which paper keeps a source when several of an owner have it: the first parsed."""
    p = table(spark, d, "papers").select("owner_id", *PAPER, "source_hash", "parsed_at").distinct()
    return S.first_of(p, ["owner_id", "source_hash"], ["parsed_at", *PAPER]).select(*PAPER, "wins")


def highlight_list(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest retrieved blocks of each paper, those without a time last."""
    r = table(spark, d, "retrieved_blocks").select(*PAPER, "retrieval_no", "retrieved_at").distinct()
    return S.listing(r, PAPER, [F.desc_nulls_last("retrieved_at"), F.col("retrieval_no")], 50).select(*PAPER, "retrieval_no", "place")


def thread_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every canvas node up to 64 links below its root, in order of depth and creation."""
    made = table(spark, d, "canvas_nodes").groupBy("paper_id", "node_id").agg(F.min("created_at").alias("created_at"))
    t = p2_paths(spark, d).where("forest = 'canvas' and node_depth between 0 and 64").join(made, ["paper_id", "node_id"])
    return S.listing(t, ["paper_id", "root_id"], ["node_depth", "created_at", "node_id"]).select("paper_id", "root_id", "node_id", "node_depth", "place")


def _log(events: DataFrame) -> DataFrame:
    what = F.when(F.col("event_type").isin("view", "signup"), "claim").when(F.col("event_type") == "click", "renew").when(F.col("event_type") == "purchase", "finish").otherwise("fail")
    return events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"), what.alias("what"), (F.col("event_id") % 3).alias("worker"), F.col("ts").cast("timestamp").alias("stamp"))


def job_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as the log of a job, leases a day long."""
    j = job_log(_log(table(spark, d, "events")), "user_id", "event_id", "at_s", "what", "worker", lease=86_400.0)
    return j.select("user_id", "event_id", "state", "tries", "token", "accepted", "reason")


def stream_job_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The same log as a stream."""
    j = job_stream(_log(read_events(spark, d, EVENTS, "events.parquet")), "user_id", "event_id", "at_s", "what", "worker", "stamp", lease=86_400.0)
    return drain(j, "append").select(F.col("key").alias("user_id"), F.col("number").alias("event_id"), "state", "tries", "token", "accepted", "reason")


def job_now(spark: SparkSession, d: str) -> DataFrame:
    """The state of each job after its whole log."""
    last = job_timeline(spark, d).groupBy("user_id").agg(F.max_by(F.struct("state", "tries", "token"), "event_id").alias("s"), F.sum((~F.col("accepted")).cast("long")).alias("refused"))
    return last.select("user_id", "s.state", "s.tries", "s.token", "refused")


def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    """For each question what its semantic stage found of the blocks of its selected stage."""
    r = table(spark, d, "retrieved_blocks").select("question_id", "ladder_stage", "block_id").distinct()
    return E.set_scores(r.where("ladder_stage = 'semantic'"), r.where("ladder_stage = 'selected'"), ["question_id"], ["block_id"])


def caption_scores(spark: SparkSession, d: str) -> DataFrame:
    """For each paper the caption links of its relations against the parents that the captions name."""
    found = table(spark, d, "relations").where("rel_type = 'caption_of'").select(*PAPER, F.col("from_block").alias("caption"), F.col("to_block").alias("owner"))
    gold = table(spark, d, "blocks").where("block_type = 'caption' and parent_id is not null").select(*PAPER, F.col("block_id").alias("caption"), F.col("parent_id").alias("owner"))
    return E.set_scores(found, gold, PAPER, ["caption", "owner"])


def _regions(spark: SparkSession, d: str, generation: int, side: str) -> DataFrame:
    b = table(spark, d, "blocks").where((F.col("generation") == generation) & F.col("bbox").isNotNull())
    return b.select("paper_id", "page_index", F.col("block_type").alias("kind"), F.col("block_no").alias(f"{side}_no"), F.col("bbox").alias(f"{side}_box")).distinct()


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The regions of papers with two generations: the first as gold, the second as found."""
    gold, found = _regions(spark, d, 1, "gold"), _regions(spark, d, 2, "found")
    return gold.join(found.select("paper_id").distinct(), "paper_id", "left_semi"), found.join(gold.select("paper_id").distinct(), "paper_id", "left_semi")


def region_scores(spark: SparkSession, d: str) -> DataFrame:
    """Macro f1 of each paper at overlaps of 0.5 and 0.75, and at 0.5 without misses that another kind substitutes."""
    gold, found = _both(spark, d)
    page, out = ["paper_id", "page_index"], None
    for name, least in (("half", 0.5), ("strict", 0.75), ("lenient", 0.5)):
        pairs = greedy_match(E.best_overlaps(gold, found, page, least), [*page, "kind"], "gold_no", "found_no", "overlap")
        wanted = gold
        if name == "lenient":
            missed = gold.join(pairs.select(*page, "kind", "gold_no"), [*page, "kind", "gold_no"], "left_anti")
            wanted = gold.join(E.substitutes(missed, found, page), [*page, "kind", "gold_no"], "left_anti")
        score = E.macro_f1(E.kind_scores(pairs, wanted, found, ["paper_id"]), ["paper_id"]).select("paper_id", F.col("macro_f1").alias(name))
        out = score if out is None else out.join(score, "paper_id", "full")
    return out


def overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    """For each paper and kind how many gold and found regions there are and how many gold ones some found one overlaps by a half."""
    gold, found = _both(spark, d)
    hit = E.best_overlaps(gold, found, ["paper_id", "page_index"], 0.5).select("paper_id", "kind", "gold_no").distinct()
    return E.kind_scores(hit, gold, found, ["paper_id"]).select("paper_id", "kind", "gold", "found", "matched", "f1")


def order_scores(spark: SparkSession, d: str) -> DataFrame:
    """How far the reading order of a page's blocks is the same in both generations."""
    b = table(spark, d, "blocks").where("doc_order is not null").select("paper_id", "generation", "page_index", "block_id", "doc_order").distinct()
    a, c = b.where("generation = 1").select("paper_id", "page_index", "block_id", F.col("doc_order").alias("gold_at")), b.where("generation = 2").select("paper_id", "page_index", "block_id", F.col("doc_order").alias("found_at"))
    return E.order_concordance(a.join(c, ["paper_id", "page_index", "block_id"]), ["paper_id", "page_index"])


def value_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The median over users of what they purchased to what they viewed, of users that did both."""
    return E.common_ratio(table(spark, d, "events"), ["user_id"], "event_type", "purchase", "view", "value")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    b = table(spark, d, "blocks").where("doc_order is not null").select(*PAPER, "block_id", "block_no", "doc_order", F.length(F.coalesce("text", F.lit(""))).alias("n")).distinct()
    w = W.partitionBy(*PAPER).orderBy("doc_order", "block_no")
    return b.select(*PAPER, "block_no", F.coalesce(F.sum(F.col("n") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def block_at_offset(spark: SparkSession, d: str) -> DataFrame:
    """For offsets 0, 777, 1554, … into each paper's text the block that holds them."""
    stream = _stream(spark, d)
    end = stream.groupBy(*PAPER).agg(F.max("start").alias("e"))
    asked = end.select(*PAPER, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("e"), F.lit(777).cast("bigint"))).alias("place"))
    return O.as_of(asked, stream, PAPER, "place", "start", "block_no")


def visible_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages that a window 900 high shows a third of the way down each paper, with one more on both sides."""
    from pyspark.sql import Window as W

    p = table(spark, d, "paper_pages").select(*PAPER, "page_index", "height").distinct()
    w = W.partitionBy(*PAPER).orderBy("page_index").rowsBetween(W.unboundedPreceding, -1)
    spans = p.select(*PAPER, F.col("page_index").alias("place"), F.coalesce(F.sum(F.col("height") + 16).over(w), F.lit(0.0)).alias("top"), "height")
    views = spans.groupBy(*PAPER).agg((F.sum(F.col("height") + 16) / 3).alias("view_top")).withColumn("view_height", F.lit(900.0))
    return O.visible(spans, views, PAPER).select(*PAPER, "first_place", "last_place", "main_place")


def _centres(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox")
    return table(spark, d, "blocks").where("flow_kind = 'body' and bbox is not null").select(*PAPER, "page_index", F.col("block_no").alias("point_no"), ((b[0] + b[2]) / 2).alias("x"), ((b[1] + b[3]) / 2).alias("y")).distinct()


def _boxes(spark: SparkSession, d: str, condition: str) -> DataFrame:
    return table(spark, d, "blocks").where(condition).where("bbox is not null").select(*PAPER, "page_index", F.col("block_no").alias("box_no"), F.col("bbox").alias("box")).distinct()


def block_under_point(spark: SparkSession, d: str) -> DataFrame:
    """The smallest body block over the centre of each body block, two points around it included."""
    return O.box_at(_centres(spark, d), _boxes(spark, d, "flow_kind = 'body'"), [*PAPER, "page_index"], 2.0)


def nearest_block(spark: SparkSession, d: str) -> DataFrame:
    """The figure or table nearest to each caption, at most 60 points away."""
    shapes = _boxes(spark, d, "block_type = 'caption'").withColumnsRenamed({"box_no": "shape_no", "box": "shape"})
    return O.nearest_box(shapes, _boxes(spark, d, "block_type in ('figure', 'table')"), [*PAPER, "page_index"], 60.0)


def sampled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Four pages of each paper, evenly spaced, the first and the last among them."""
    n = table(spark, d, "paper_pages").select(*PAPER, "page_index").distinct().groupBy(*PAPER).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select(*PAPER, F.explode(O.even_sample(F.col("n"), 4)).alias("page_index"))


def knn_unclaimed(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors that nothing has claimed yet (those of numbers divisible by 7 are claimed)."""
    e = table(spark, d, "embeddings")
    hits = nearest_vectors(e.where("vec_id % 7 <> 0"), e.where("vec_id % 100 = 0"), "vec_id", "embedding", ["label"], 5)
    return hits.select("query_id", "hit_id", "distance", "place")


def nearest_rank_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The middle and the 95th hundredth of the values of each kind of event, as values that occur."""
    return E.at_ranks(table(spark, d, "events"), ["event_type"], "value", {"p50": "floor(0.5 * n) + 1", "p95": "least(n, floor(0.95 * n) + 1)"})


def value_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The least, the median and the greatest value of each kind of event."""
    r = E.at_ranks(table(spark, d, "events"), ["event_type"], "value", {"low": "1", "a": "floor((n + 1) / 2)", "b": "floor(n / 2) + 1", "high": "n"})
    return r.select("event_type", "low", F.round((F.col("a") + F.col("b")) / 2, 6).alias("mid"), "high")


def section_siblings_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The six blocks of the same parent nearest to each block in reading order, the earlier of equals first."""
    from pyspark.sql import Window as W

    b = table(spark, d, "blocks").where("doc_order is not null").select(*PAPER, "block_id", "block_no", "doc_order", "parent_id").distinct()
    b = b.withColumn("rank", F.row_number().over(W.partitionBy(*PAPER).orderBy("doc_order", "block_no"))).where("parent_id is not null")
    w = W.partitionBy(*PAPER, "parent_id").orderBy("rank")
    near = F.struct("rank", "block_id")
    around = F.array(*(f(near, k).over(w) for f in (F.lag, F.lead) for k in range(1, 7)))
    far = F.transform(F.filter(around, lambda x: x.isNotNull()), lambda x: F.struct(F.abs(x["rank"] - F.col("rank")).alias("d"), x["rank"].alias("r"), x["block_id"].alias("near_id")))
    return b.withColumn("near", F.slice(F.array_sort(far), 1, 6)).select(*PAPER, "block_id", F.explode("near").alias("x")).select(*PAPER, "block_id", "x.near_id")


def cap_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which book sections fit their owner's caps of 200 rows and 100 KiB, in order of generation."""
    b = table(spark, d, "book_sections").select("owner_id", "section_no", "generated_at", "content").distinct()
    t = O.running_totals(b, ["owner_id"], ["generated_at", "section_no"], {"place": F.lit(1), "bytes": F.octet_length("content")})
    return t.select("owner_id", "section_no", F.when(F.col("place") > 200, "rows").when(F.col("bytes") > 102_400, "bytes").otherwise("ok").alias("gate"))


def papers_newest_first(spark: SparkSession, d: str) -> DataFrame:
    """The place of each paper among its owner's, newest first."""
    p = table(spark, d, "papers").select("owner_id", *PAPER, "created_at").distinct().withColumns({"_a": -F.unix_micros("created_at"), "_g": -F.col("generation")})
    return O.running_totals(p, ["owner_id"], ["_a", "_g", "paper_id"], {"place": F.lit(1)}).select("owner_id", *PAPER, "place")


QUERIES = {f.__name__: f for f in (note_state, note_audit, notes_cascaded, anchors_dangling, unique_sources, highlight_list, thread_tree, job_timeline, stream_job_timeline, job_now, evidence_scores, caption_scores, region_scores, overlap_counts, order_scores, value_ratio, block_at_offset, visible_pages, block_under_point, nearest_block, sampled_pages, knn_unclaimed, nearest_rank_quantile, value_intervals, section_siblings_nearest, cap_gate, papers_newest_first)}

_CHANGES = "ch AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind, value, CASE WHEN event_type = 'purchase' THEN props END AS note FROM events), b4 AS (SELECT *, (SELECT arg_max(p.kind, (p.ts, p.event_id)) FROM ch p WHERE p.user_id = c.user_id AND p.kind <> 'update' AND (p.ts, p.event_id) < (c.ts, c.event_id)) AS prior FROM ch c), ok AS (SELECT *, CASE kind WHEN 'insert' THEN coalesce(prior, 'delete') = 'delete' ELSE coalesce(prior, 'delete') = 'insert' END AS accepted FROM b4)"
_SCORES = "SELECT {g}, correct::BIGINT AS correct, (nf - correct)::BIGINT AS false_items, (ng - correct)::BIGINT AS missed, CASE WHEN nf > 0 THEN round(correct / nf, 6) END AS precision, CASE WHEN ng > 0 THEN round(correct / ng, 6) END AS recall, round(2.0 * correct / (nf + ng), 6)::DOUBLE AS f1 FROM t"
_ROWS = "(SELECT DISTINCT paper_id, generation, page_index, block_no, block_id, block_type, flow_kind, doc_order, bbox FROM blocks WHERE bbox IS NOT NULL)"
_JOB = "(CASE WHEN event_type IN ('view', 'signup') THEN 'claim' WHEN event_type = 'click' THEN 'renew' WHEN event_type = 'purchase' THEN 'finish' ELSE 'fail' END)"
#: The log of each job folded by recursion over its entries.
_JOBS = f"""WITH RECURSIVE l AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS at_s, {_JOB} AS what, event_id % 3 AS worker, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    s AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'queued' AS state, NULL::BIGINT AS holder, 0 AS tries, 0::DOUBLE AS until, true AS accepted, '' AS reason FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT l.user_id, l.k, l.event_id,
            CASE WHEN s.state IN ('done', 'dead') THEN s.state WHEN what = 'claim' THEN CASE WHEN s.state = 'running' AND at_s < until THEN 'running' WHEN tries >= 3 THEN 'dead' ELSE 'running' END WHEN NOT held THEN s.state WHEN what = 'renew' THEN 'running' WHEN what = 'finish' THEN 'done' WHEN tries >= 3 THEN 'dead' ELSE 'queued' END,
            CASE WHEN s.state IN ('done', 'dead') THEN s.holder WHEN what = 'claim' THEN CASE WHEN s.state = 'running' AND at_s < until THEN s.holder WHEN tries >= 3 THEN NULL ELSE worker END WHEN NOT held OR what = 'renew' THEN s.holder END,
            CASE WHEN free AND what = 'claim' AND tries < 3 THEN tries + 1 ELSE tries END,
            CASE WHEN (free AND what = 'claim' AND tries < 3) OR (held AND what = 'renew') THEN at_s + 86400 ELSE until END,
            CASE WHEN what = 'claim' THEN free AND tries < 3 ELSE held END,
            CASE WHEN s.state IN ('done', 'dead') THEN 'finished' WHEN what = 'claim' THEN CASE WHEN NOT free THEN 'leased' WHEN tries >= 3 THEN 'no tries left' ELSE '' END WHEN NOT held THEN 'no lease' ELSE '' END
        FROM (SELECT s.*, s.state NOT IN ('done', 'dead') AND NOT (s.state = 'running' AND l.at_s < s.until) AS free, s.state = 'running' AND coalesce(s.holder = l.worker, false) AND l.at_s < s.until AS held FROM s JOIN l ON l.user_id = s.user_id AND l.k = s.k + 1) s JOIN l ON l.user_id = s.user_id AND l.k = s.k + 1)"""

SQL = {
    "cap_gate": "SELECT owner_id, section_no, CASE WHEN place > 200 THEN 'rows' WHEN bytes > 102400 THEN 'bytes' ELSE 'ok' END AS gate FROM (SELECT owner_id, section_no, row_number() OVER (PARTITION BY owner_id ORDER BY generated_at, section_no) AS place, sum(octet_length(encode(coalesce(content, '')))) OVER (PARTITION BY owner_id ORDER BY generated_at, section_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bytes FROM (SELECT DISTINCT owner_id, section_no, generated_at, content FROM book_sections))",
    "papers_newest_first": "SELECT owner_id, paper_id, generation, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, generation DESC, paper_id) AS place FROM (SELECT DISTINCT owner_id, paper_id, generation, created_at FROM papers)",
    "nearest_rank_quantile": "SELECT event_type, min(CASE WHEN k = CAST(floor(0.5 * n) AS BIGINT) + 1 THEN value END) AS p50, min(CASE WHEN k = least(n, CAST(floor(0.95 * n) AS BIGINT) + 1) THEN value END) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type",
    "value_intervals": "SELECT event_type, min(value) AS low, round(median(value), 6) AS mid, max(value) AS high FROM events GROUP BY event_type",
    "section_siblings_nearest": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY paper_id, generation ORDER BY doc_order, block_no) AS rank FROM (SELECT DISTINCT paper_id, generation, block_id, block_no, doc_order, parent_id FROM blocks WHERE doc_order IS NOT NULL)) SELECT paper_id, generation, block_id, near_id FROM (SELECT a.paper_id, a.generation, a.block_id, c.block_id AS near_id, row_number() OVER (PARTITION BY a.paper_id, a.generation, a.block_id ORDER BY abs(a.rank - c.rank), c.rank) AS k FROM o a JOIN o c ON a.paper_id = c.paper_id AND a.generation = c.generation AND a.parent_id = c.parent_id AND a.block_id <> c.block_id) WHERE k <= 6",
    "note_state": f"WITH {_CHANGES}, a AS (SELECT * FROM ok WHERE accepted), s AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE kind = 'insert') AS born, max((ts, event_id)) FILTER (WHERE kind = 'delete') AS gone FROM a GROUP BY user_id) SELECT a.user_id, arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value, arg_max(note, (ts, event_id)) FILTER (WHERE note IS NOT NULL) AS note, count(*) AS version FROM a JOIN s ON s.user_id = a.user_id WHERE (gone IS NULL OR gone < born) AND (ts, event_id) >= born GROUP BY a.user_id",
    "note_audit": f"WITH {_CHANGES} SELECT c.event_id, c.user_id, CASE WHEN c.accepted THEN c.kind ELSE 'denied' END AS outcome, CASE WHEN (CASE WHEN c.accepted THEN c.kind = 'delete' ELSE coalesce(c.prior, 'delete') = 'delete' END) THEN 0 ELSE (SELECT count(*) FROM ok p WHERE p.user_id = c.user_id AND p.accepted AND (p.ts, p.event_id) <= (c.ts, c.event_id) AND (p.ts, p.event_id) >= (SELECT max((q.ts, q.event_id)) FROM ok q WHERE q.user_id = c.user_id AND q.accepted AND q.kind = 'insert' AND (q.ts, q.event_id) <= (c.ts, c.event_id))) END::BIGINT AS version FROM ok c",
    "notes_cascaded": "SELECT DISTINCT retrieval_no, block_id FROM retrieved_blocks r WHERE EXISTS (FROM blocks b WHERE (b.owner_id, b.paper_id, b.generation, b.block_id) = (r.owner_id, r.paper_id, r.generation, r.block_id))",
    "anchors_dangling": "SELECT paper_id, generation, block_id FROM (SELECT paper_id, generation, from_block AS block_id FROM relations UNION SELECT paper_id, generation, to_block FROM relations) EXCEPT SELECT paper_id, generation, block_id FROM blocks",
    "unique_sources": "SELECT paper_id, generation, row_number() OVER (PARTITION BY owner_id, source_hash ORDER BY parsed_at, paper_id, generation) = 1 AS wins FROM (SELECT DISTINCT owner_id, paper_id, generation, source_hash, parsed_at FROM papers)",
    "highlight_list": "SELECT * FROM (SELECT paper_id, generation, retrieval_no, row_number() OVER (PARTITION BY paper_id, generation ORDER BY retrieved_at DESC NULLS LAST, retrieval_no) AS place FROM (SELECT DISTINCT paper_id, generation, retrieval_no, retrieved_at FROM retrieved_blocks)) WHERE place <= 50",
    "thread_tree": _TREES + "SELECT d.paper_id, d.root_id, d.node_id, d.node_depth::INTEGER AS node_depth, row_number() OVER (PARTITION BY d.paper_id, d.root_id ORDER BY d.node_depth, m.at, d.node_id) AS place FROM down d JOIN (SELECT paper_id, node_id, min(created_at) AS at FROM canvas_nodes GROUP BY ALL) m ON (m.paper_id, m.node_id) = (d.paper_id, d.node_id) WHERE d.forest = 'canvas' AND d.node_depth <= 64",
    "job_timeline": _JOBS + " SELECT user_id, event_id, state, tries::INTEGER AS tries, tries::BIGINT AS token, accepted, reason FROM s WHERE k > 0",
    "stream_job_timeline": _JOBS + " SELECT user_id, event_id, state, tries::INTEGER AS tries, tries::BIGINT AS token, accepted, reason FROM s WHERE k > 0",
    "job_now": _JOBS + " SELECT user_id, arg_max(state, k) AS state, arg_max(tries, k)::INTEGER AS tries, arg_max(tries, k)::BIGINT AS token, count(*) FILTER (WHERE NOT accepted) AS refused FROM s GROUP BY user_id",
    "evidence_scores": "WITH f AS (SELECT DISTINCT question_id, block_id FROM retrieved_blocks WHERE ladder_stage = 'semantic'), g AS (SELECT DISTINCT question_id, block_id FROM retrieved_blocks WHERE ladder_stage = 'selected'), t AS (SELECT question_id, (SELECT count(*) FROM f WHERE f.question_id = q.question_id) AS nf, (SELECT count(*) FROM g WHERE g.question_id = q.question_id) AS ng, (SELECT count(*) FROM f JOIN g USING (question_id, block_id) WHERE f.question_id = q.question_id) AS correct FROM (SELECT question_id FROM f UNION SELECT question_id FROM g) q) " + _SCORES.format(g="question_id"),
    "caption_scores": "WITH f AS (SELECT DISTINCT paper_id, generation, from_block AS c, to_block AS o FROM relations WHERE rel_type = 'caption_of'), g AS (SELECT DISTINCT paper_id, generation, block_id AS c, parent_id AS o FROM blocks WHERE block_type = 'caption' AND parent_id IS NOT NULL), u AS (SELECT coalesce(f.paper_id, g.paper_id) AS paper_id, coalesce(f.generation, g.generation) AS generation, f.c IS NOT NULL AS inf, g.c IS NOT NULL AS ing FROM f FULL JOIN g ON (f.paper_id, f.generation, f.c, f.o) = (g.paper_id, g.generation, g.c, g.o)), t AS (SELECT paper_id, generation, count(*) FILTER (inf) AS nf, count(*) FILTER (ing) AS ng, count(*) FILTER (inf AND ing) AS correct FROM u GROUP BY ALL) " + _SCORES.format(g="paper_id, generation"),
    "overlap_counts": f"WITH r AS (SELECT * FROM {_ROWS} WHERE paper_id IN (SELECT paper_id FROM {_ROWS} WHERE generation = 1) AND paper_id IN (SELECT paper_id FROM {_ROWS} WHERE generation = 2)), a AS (SELECT * FROM r WHERE generation = 1), c AS (SELECT * FROM r WHERE generation = 2), o AS (SELECT DISTINCT a.paper_id, a.block_type, a.block_no FROM (SELECT a.paper_id, a.block_type, a.block_no, a.bbox AS v, c.bbox AS u, greatest(0, least(a.bbox[3], c.bbox[3]) - greatest(a.bbox[1], c.bbox[1])) * greatest(0, least(a.bbox[4], c.bbox[4]) - greatest(a.bbox[2], c.bbox[2])) AS i FROM a JOIN c ON (a.paper_id, a.page_index, a.block_type) = (c.paper_id, c.page_index, c.block_type)) a WHERE round(i / nullif(greatest(v[3] - v[1], 0) * greatest(v[4] - v[2], 0) + greatest(u[3] - u[1], 0) * greatest(u[4] - u[2], 0) - i, 0), 6) >= 0.5), k AS (SELECT paper_id, block_type AS kind, count(*) FILTER (generation = 1) AS gold, count(*) FILTER (generation = 2) AS found FROM r WHERE generation IN (1, 2) GROUP BY ALL) SELECT paper_id, kind, gold, found, coalesce(m, 0)::BIGINT AS matched, round(2.0 * coalesce(m, 0) / (gold + found), 6)::DOUBLE AS f1 FROM k LEFT JOIN (SELECT paper_id, block_type AS kind, count(*) AS m FROM o GROUP BY ALL) USING (paper_id, kind)",
    "order_scores": f"WITH p AS (SELECT a.paper_id, a.page_index, a.block_id, a.doc_order AS g, c.doc_order AS f FROM {_ROWS.replace(' WHERE bbox IS NOT NULL', '')} a JOIN {_ROWS.replace(' WHERE bbox IS NOT NULL', '')} c USING (paper_id, page_index, block_id) WHERE a.generation = 1 AND c.generation = 2 AND a.doc_order IS NOT NULL AND c.doc_order IS NOT NULL) SELECT x.paper_id, x.page_index, coalesce(round(sum(CASE WHEN (y.g - x.g) * (y.f - x.f) > 0 THEN 1 ELSE 0 END) / nullif(count(y.g), 0), 6), -1)::DOUBLE AS concordance FROM p x LEFT JOIN p y ON y.paper_id = x.paper_id AND y.page_index = x.page_index AND y.g > x.g GROUP BY x.paper_id, x.page_index",
    "value_ratio": "SELECT round(median(s / f), 6) AS median_ratio, count(*) AS groups FROM (SELECT user_id, sum(value) FILTER (event_type = 'purchase') AS s, sum(value) FILTER (event_type = 'view') AS f FROM events GROUP BY user_id) WHERE s IS NOT NULL AND f > 0",
    "block_at_offset": "WITH b AS (SELECT DISTINCT paper_id, generation, block_no, doc_order, length(coalesce(text, '')) AS n FROM blocks WHERE doc_order IS NOT NULL), s AS (SELECT paper_id, generation, block_no, coalesce(sum(n + 1) OVER (PARTITION BY paper_id, generation ORDER BY doc_order, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM b), e AS (SELECT paper_id, generation, max(start) AS last FROM s GROUP BY ALL), q AS (SELECT paper_id, generation, unnest(range(0, last + 1, 777))::BIGINT AS place FROM e) SELECT q.paper_id, q.generation, q.place, s.block_no FROM q ASOF JOIN s ON q.paper_id = s.paper_id AND q.generation = s.generation AND q.place >= s.start",
    "visible_pages": "WITH p AS (SELECT DISTINCT paper_id, generation, page_index, height FROM paper_pages), t AS (SELECT *, (SELECT coalesce(sum(o.height + 16), 0) FROM p o WHERE (o.paper_id, o.generation) = (p.paper_id, p.generation) AND o.page_index < p.page_index) AS top FROM p), v AS (SELECT paper_id, generation, sum(height + 16) / 3 AS y FROM p GROUP BY ALL), m AS (SELECT t.*, least(top + height, y + 900) - greatest(top, y) AS share FROM t JOIN v USING (paper_id, generation)) SELECT paper_id, generation, (greatest(min(page_index) FILTER (share > 0) - 1, 0))::INTEGER AS first_place, (least(max(page_index) FILTER (share > 0) + 1, max(page_index)))::INTEGER AS last_place, (arg_max(page_index, (share, -page_index)) FILTER (share > 0))::INTEGER AS main_place FROM m GROUP BY ALL",
    "block_under_point": f"SELECT point_no, box_no FROM (SELECT p.block_no AS point_no, b.block_no AS box_no, row_number() OVER (PARTITION BY p.block_no ORDER BY greatest(b.bbox[3] - b.bbox[1], 0) * greatest(b.bbox[4] - b.bbox[2], 0), b.block_no) AS k FROM {_ROWS} p JOIN {_ROWS} b ON (p.paper_id, p.generation, p.page_index) = (b.paper_id, b.generation, b.page_index) WHERE p.flow_kind = 'body' AND b.flow_kind = 'body' AND (p.bbox[1] + p.bbox[3]) / 2 BETWEEN b.bbox[1] - 2 AND b.bbox[3] + 2 AND (p.bbox[2] + p.bbox[4]) / 2 BETWEEN b.bbox[2] - 2 AND b.bbox[4] + 2) WHERE k = 1",
    "nearest_block": f"SELECT shape_no, box_no, cost FROM (SELECT shape_no, box_no, cost, row_number() OVER (PARTITION BY shape_no ORDER BY cost, box_no) AS k FROM (SELECT s.block_no AS shape_no, b.block_no AS box_no, round(sqrt(power((s.bbox[1] + s.bbox[3] - b.bbox[1] - b.bbox[3]) / 2, 2) + power((s.bbox[2] + s.bbox[4] - b.bbox[2] - b.bbox[4]) / 2, 2)) * coalesce(least(16, greatest(sa, ba) / nullif(least(sa, ba), 0)), 16), 6) AS cost FROM (SELECT *, greatest(bbox[3] - bbox[1], 0) * greatest(bbox[4] - bbox[2], 0) AS sa FROM {_ROWS} WHERE block_type = 'caption') s JOIN (SELECT *, greatest(bbox[3] - bbox[1], 0) * greatest(bbox[4] - bbox[2], 0) AS ba FROM {_ROWS} WHERE block_type IN ('figure', 'table')) b ON (s.paper_id, s.generation, s.page_index) = (b.paper_id, b.generation, b.page_index) WHERE sqrt(power(greatest(b.bbox[1] - s.bbox[3], s.bbox[1] - b.bbox[3], 0), 2) + power(greatest(b.bbox[2] - s.bbox[4], s.bbox[2] - b.bbox[4], 0), 2)) <= 60)) WHERE k = 1",
    "sampled_pages": "SELECT DISTINCT paper_id, generation, CASE WHEN n <= 4 THEN i ELSE round_even(i * (n - 1) / 3.0, 0) END::INTEGER AS page_index FROM (SELECT paper_id, generation, count(DISTINCT page_index) AS n FROM paper_pages GROUP BY ALL), (SELECT unnest(range(0, 4)) AS i) WHERE i < n",
    "knn_unclaimed": "SELECT query_id, hit_id, distance, place::INTEGER AS place FROM (SELECT a.vec_id AS query_id, c.vec_id AS hit_id, round(list_distance(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6), c.vec_id) AS place FROM embeddings a JOIN embeddings c ON a.label = c.label WHERE a.vec_id % 100 = 0 AND c.vec_id % 7 <> 0) WHERE place <= 5",
}
