"""Streams and sinks over the given tables, run to the end of what is there, with the SQL that checks them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ledgerlark.operators import order_moves
from ledgerlark.operators import scoring as S
from ledgerlark.operators import stock as stock_moves
from ledgerlark.plans.text_queries import SECTIONED
from ledgerlark.plans.views import ANA, LIN, ORD, RUN, lines, orders, runs
from ledgerlark.session import table
from ledgerlark.sources import writers
from ledgerlark.sources.increments import DocumentIndex
from ledgerlark.streaming import patrol


#: File names that are put to the ends of the pages' paths.
FILES = ("", "/a.TXT", "/../b.md", "/c.exe", "/d.7z", "/e", "/f.tar.json")


def _folder(spark) -> str:  # noqa: ANN001
    """A new folder under the shared checkpoint folder. Only a local session may do without, as its tasks run in the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='ledgerlark-')}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _stream(s, d, name):  # noqa: ANN001, ANN202
    """The table as a stream: a folder of part files by its own path, a single file by its name in the folder."""
    path = f"{d}/{name}.parquet"
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    reader = s.readStream.schema(table(s, d, name).schema)
    if at.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(d)


def _analysed(s, d, *kept):  # noqa: ANN001, ANN002, ANN202
    """The risk rules over a batch of documents, whose columns kept are handed on."""
    labels = table(s, d, "labels")

    def analyse(batch):  # noqa: ANN001, ANN202
        label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "neutral")
        ready = batch.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", label.alias("label"), (F.col("doc_id") % 5 + 1).cast("int").alias("rating"), (F.col("doc_id") % 100 / 100).cast("decimal(6,4)").alias("confidence"), (F.col("doc_id") * 7 % 100 / 100).cast("decimal(6,4)").alias("negative_score"), *kept)
        return S.risk_tasks(ready, ("clown", "hates"), kept)

    return analyse


def patrol_stream(s, d):  # noqa: ANN001, ANN202
    """Reviews streamed through the risk rules; the result is read back from the sink."""
    folder = _folder(s)
    patrol.patrol(_stream(s, d, "documents"), _analysed(s, d), f"{folder}/out", f"{folder}/state", ["doc_id"], buckets=16).awaitTermination()
    return s.read.parquet(f"{folder}/out").select("analysis_id", "risk_type", "risk_level", "status")


#: Rows that a tick of the patrol query admits.
TICK_ROWS = 400


def patrol_ticks(s, d):  # noqa: ANN001, ANN202
    """The patrol's ticks until nothing is pending, made up in one pass. Each text comes twice, the second time after all
    others, and is analysed the first time only."""
    docs = table(s, d, "documents").withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    ticks = patrol.PatrolTicks(s, _folder(s), ["doc_id"], ["round", "doc_id"], TICK_ROWS, buckets=16)
    ticks.catch_up(docs, _analysed(s, d, "tick"))
    return ticks.results().select("analysis_id", "risk_type", "risk_level", F.col("tick").cast("int").alias("tick"))


def daily_stream(s, d):  # noqa: ANN001, ANN202
    events = _stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return patrol.run_to_end(patrol.daily(events, "ts"), f"daily_{uuid.uuid4().hex}", f"{_folder(s)}/state", "complete")


#: When the streams of order events are run, what has arrived by then is a batch; the last run takes the rest.
ARRIVALS = ("1997-01-01", "1999-01-01", "9999-01-01")


def unpaid_stream(s, d):  # noqa: ANN001, ANN202
    """Orders as creation events, and as payment events some minutes later, streamed through the timers in three runs.

    Every seventh creation arrives 20 days late, so after its payment and perhaps in a later run; every fiftieth payment
    arrives years late, behind the watermark of 30 days.
    """
    o = F.col("o_orderkey")
    created = F.struct(F.lit("created").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.expr("cast(o_orderdate as timestamp) + make_dt_interval(if(o_orderkey % 7 = 0, 20, 0))").alias("arrives"))
    at = "cast(o_orderdate as timestamp) + make_dt_interval(0, 0, cast(o_orderkey % 60 as int))"
    paid = F.struct(F.lit("paid").alias("kind"), F.expr(at).alias("ts"), F.expr(f"{at} + make_dt_interval(if(o_orderkey % 50 = 0, 1500, 0))").alias("arrives"))
    both = F.when(F.col("o_orderstatus") == "O", F.array(created)).otherwise(F.array(created, paid))
    events = table(s, d, "orders").select(o.alias("order_id"), F.explode(both).alias("e")).select("order_id", "e.*")
    folder, before, out = _folder(s), "0001-01-01", None
    for until in ARRIVALS:
        arrived = events.where((F.col("arrives") >= F.lit(before).cast("timestamp")) & (F.col("arrives") < F.lit(until).cast("timestamp"))).drop("arrives")
        arrived.write.mode("append").parquet(f"{folder}/in")
        stream = s.readStream.schema(arrived.schema).parquet(f"{folder}/in")
        out, before = patrol.run_into(patrol.unpaid_timeouts(stream, 30, "30 days"), f"{folder}/out", f"{folder}/state"), until
    return out.select("order_id", F.date_format("cancelled_at", "yyyy-MM-dd HH:mm").alias("cancelled_at"))


def index_roundtrip(s, d):  # noqa: ANN001, ANN202
    """Two published versions and a rollback: the first is active again."""
    index = writers.VersionedIndex(s, _folder(s))
    terms = table(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    index.stage(terms, "1")
    index.publish("1")
    index.stage(terms.withColumn("n", F.col("n") + 1), "2")
    index.publish("2")
    index.rollback()
    return index.load()


def _updated_index(s, d):  # noqa: ANN001, ANN202
    """All documents indexed, then updated with a set in which a quarter is revised, another has spaces at line ends only, some
    hold a key, some are gone, and a fifth comes again under new ids."""
    i = F.col("doc_id")
    docs = table(s, d, "documents").select(i.alias("id"), F.when(i % 3 == 0, "v2").otherwise("9").alias("version"), "text")
    text = F.when(F.col("id") % 4 == 1, F.concat("text", F.lit("\n# revised\nonce"))).when(F.col("id") % 4 == 2, F.concat(F.regexp_replace("text", "\n", " \n"), F.lit("\r\n"))).otherwise(F.col("text"))
    kept = docs.where("id % 9 > 0").select("id", "version", F.concat(text, F.when(F.col("id") % 7 == 3, "\nAPI_KEY=x").otherwise("")).alias("text"))
    index = DocumentIndex(s, f"{_folder(s)}/index")
    index.update(docs)
    index.update(kept.unionByName(docs.where("id % 5 = 0").withColumn("id", -1 - F.col("id"))))
    return index


def index_update(s, d):  # noqa: ANN001, ANN202
    """Every document that the updated index holds or that the update was about."""
    index = _updated_index(s, d)
    both = index.documents().join(index.changes(), "id", "full")
    return both.select("id", F.coalesce("change", F.lit("same")).alias("change"), F.array_join("errors", ",").alias("errors"), "version", "index_version", "n_chunks")


def index_hash(s, d):  # noqa: ANN001, ANN202
    """Counts and sums of the updated index, carried over from state to state."""
    return _updated_index(s, d).summary()


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')"
#: The documents after the update: what is new, what stays from before, and what is about neither.
UPDATED = f"""one AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE '9' END AS version, coalesce(text, '') AS raw FROM documents),
    two AS (SELECT id, version, raw || CASE WHEN id % 4 = 1 THEN chr(10) || '# revised' || chr(10) || 'once' ELSE '' END || CASE WHEN id % 7 = 3 THEN chr(10) || 'API_KEY=x' ELSE '' END AS raw FROM one WHERE id % 9 > 0 UNION ALL SELECT -1 - id, version, raw FROM one WHERE id % 5 = 0),
    a AS (SELECT id, version, {_NORMAL.format('raw')} AS text FROM one), b AS (SELECT id, version, {_NORMAL.format('raw')} AS text FROM two),
    judged AS (SELECT *, concat_ws(',', CASE WHEN contains(lower(text), 'ignore previous instructions') OR contains(lower(text), 'system prompt') THEN 'PROMPT_INJECTION_DETECTED' END, CASE WHEN contains(lower(text), 'api_key=') OR contains(lower(text), 'bearer ') THEN 'SECRET_LIKE_CONTENT_DETECTED' END) AS errors
        FROM (SELECT id, version, text, 1 AS run FROM a UNION ALL SELECT id, version, text, 2 FROM b)),
    old AS (SELECT id, version, text FROM judged WHERE run = 1 AND errors = ''), new AS (SELECT id, version, text, errors FROM judged WHERE run = 2),
    mixed AS (SELECT coalesce(new.id, old.id) AS id, new.errors, CASE WHEN new.id IS NULL THEN 'gone' WHEN errors <> '' THEN 'blocked' WHEN old.id IS NULL THEN 'added' WHEN old.text = new.text THEN 'same' ELSE 'changed' END AS change,
        old.version AS was, new.version AS now, old.text AS was_text, new.text AS now_text FROM new FULL JOIN old ON new.id = old.id),
    held AS (SELECT id, change, errors, CASE change WHEN 'added' THEN now WHEN 'changed' THEN CASE was WHEN '9' THEN '10' ELSE was || '.1' END WHEN 'gone' THEN NULL ELSE was END AS version, CASE WHEN change IN ('added', 'changed') THEN now_text WHEN change <> 'gone' THEN was_text END AS text FROM mixed),
    headed AS (SELECT id, text FROM held WHERE version IS NOT NULL), {SECTIONED},
    ids AS (SELECT id, list(substr(sha256(concat_ws(':', id, version, nth, sha256(content))), 1, 24) ORDER BY nth) AS c FROM kids JOIN held USING (id) GROUP BY id),
    indexed AS (SELECT held.*, CAST(len(c) AS BIGINT) AS n_chunks, substr(sha256('{{"chunks":["' || array_to_string(c, '","') || '"],"document_id":"' || held.id || '","version":"' || version || '"}}'), 1, 24) AS index_version FROM held LEFT JOIN ids USING (id))"""


def stock_guard(s, d):  # noqa: ANN001, ANN201
    """Every order line takes its pieces on the day of shipping, or brings them back where it was returned."""
    stock = table(s, d, "part").select(F.col("p_partkey").alias("goods_id"), (F.col("p_size") * 8).alias("number"))
    delta = F.when(F.col("flag") == "R", F.col("number")).otherwise(-F.col("number"))
    moves = lines(s, d).select("goods_id", F.col("shipped").alias("at"), (F.col("order_id") * 10 + F.col("line_no")).alias("id"), delta.alias("delta"))
    return stock_moves.allocate(stock, moves, f"{_folder(s)}/stock").select("goods_id", "id", "delta", "accepted", "stock_left")


#: What the first, second, third and further lines of an order ask for, by turns.
ASKED = (("pay", "cancel", "pay", "auto_cancel", "pay_offline"), ("ship", "refund", "pay"), ("confirm", "refund_confirm", "auto_confirm", "cancel"), ("comment", "submit", "confirm"))


def _order_history(s, d):  # noqa: ANN001, ANN202
    """Each order is submitted, but for every fifth, which is there with its status; then each of its lines asks for an action,
    in a third of the orders in the order of shipping, else in that of the lines."""
    o, n = F.col("order_id"), F.col("line_no")
    turn = F.floor(o / 5).cast("bigint")
    asked = F.coalesce(*(F.when(F.least(n, F.lit(len(ASKED))) == k + 1, F.element_at(F.array(*map(F.lit, each)), (turn % len(each) + 1).cast("int"))) for k, each in enumerate(ASKED)))
    at = F.when(o % 3 == 0, F.col("shipped")).otherwise(F.lit("1990-01-01").cast("timestamp_ntz"))
    submitted = orders(s, d).select(F.col("id").alias("order_id"), F.lit("1989-01-01").cast("timestamp_ntz").alias("at"), (F.col("id") * 10).alias("id"), F.lit("submit").alias("action"))
    moves = submitted.unionByName(lines(s, d).select("order_id", at.cast("timestamp_ntz").alias("at"), (o * 10 + n).alias("id"), asked.alias("action")))
    there = orders(s, d).where("id % 5 = 0").select(F.col("id").alias("order_id"), "status")
    return order_moves.moved(there, moves, f"{_folder(s)}/moves")


def order_stock(s, d):  # noqa: ANN001, ANN202
    """Pieces that the orders' lives took from and brought back to each product's stock."""
    moves = order_moves.stock_moves(_order_history(s, d), lines(s, d))
    return moves.groupBy("goods_id").agg(F.sum(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0)).alias("taken"), F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)).alias("returned"))


def order_coupons(s, d):  # noqa: ANN001, ANN202
    """A coupon for every order, after the order's life."""
    return order_moves.coupon_states(_order_history(s, d), orders(s, d).select((F.col("id") + 7).alias("coupon_id"), F.col("id").alias("order_id")))


def _legal(action: str, state: str) -> str:
    """The state that follows, null where the move isn't legal, as SQL."""
    return "CASE " + " ".join(f"WHEN {state} = {a} AND {action} = '{x}' THEN {b}" for a, x, b in order_moves.LEGAL) + " END"


HISTORY = f"""{ORD}, {LIN}, ask AS (SELECT id AS order_id, TIMESTAMP '1989-01-01' AS ts, id * 10 AS id, 'submit' AS action FROM ord UNION ALL
        SELECT order_id, CASE WHEN order_id % 3 = 0 THEN shipped ELSE TIMESTAMP '1990-01-01' END, order_id * 10 + line_no, CASE least(line_no, {len(ASKED)}) {' '.join(f"WHEN {k + 1} THEN {list(each)}[order_id // 5 % {len(each)} + 1]" for k, each in enumerate(ASKED))} END FROM lin),
    nth AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, id) AS nth FROM ask),
    fold AS (SELECT order_id, CAST(0 AS BIGINT) AS nth, ts, id, action, 0 AS before, CASE WHEN order_id % 5 = 0 THEN (SELECT status FROM ord WHERE ord.id = order_id) ELSE 0 END AS after, false AS accepted FROM nth WHERE nth = 1
        UNION ALL SELECT n.order_id, n.nth, n.ts, n.id, n.action, f.after, coalesce({_legal('n.action', 'f.after')}, f.after), {_legal('n.action', 'f.after')} IS NOT NULL FROM fold f JOIN nth n ON n.order_id = f.order_id AND n.nth = f.nth + 1),
    done AS (SELECT * FROM fold WHERE nth > 0)"""
_EFFECT = "CASE WHEN action = 'submit' THEN -1 WHEN action IN ('cancel', 'auto_cancel', 'refund_confirm') THEN 1 END"


QUERIES = {
    "m05_order_history": lambda s, d: _order_history(s, d).select("order_id", "id", "action", "before", "after", "accepted"),
    "m05_order_stock": order_stock,
    "m05_order_coupons": order_coupons,
    "t01_patrol_stream": patrol_stream,
    "t01_patrol_ticks": patrol_ticks,
    "t04_unpaid_stream": unpaid_stream,
    "t05_ttl_idempotency": lambda s, d: patrol.first_in_ttl(runs(s, d).select("id", "user_id", "created"), "user_id", "created").select("id", "processed"),
    "t10_daily_window": daily_stream,
    "s03_violations": lambda s, d: writers.violations(table(s, d, "documents").select((F.col("doc_id") % 900).alias("id"), F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 70 == 0, None).otherwise(F.col("lang")).alias("lang")), ["source", "lang"], "id"),
    "f20_stock_guard": stock_guard,
    "r20_index_hash": index_hash,
    "r21_update": index_update,
    "s06_ingest_errors": lambda s, d: table(s, d, "pages").select("page_id", F.array_join(writers.ingest_errors(F.concat(F.regexp_extract("url", r"[^?#]*", 0), F.element_at(F.array(*map(F.lit, FILES)), (F.col("page_id") % len(FILES) + 1).cast("int"))), F.octet_length("html") * F.when(F.col("page_id") % 11 == 0, 5000).otherwise(1)), ",").alias("errors")),
    "s08_index_rollback": index_roundtrip,
    "s17_schema_evolution": lambda s, d: writers.with_columns(table(s, d, "nation"), s.read.parquet(f"{d}/nation.parquet").schema.add("n_comment", "string")).where("n_comment is null").select("n_nationkey", "n_name", "n_comment"),
}

ORACLE_SQL = {
    "m05_order_history": f"WITH RECURSIVE {HISTORY} SELECT order_id, id, action, CAST(before AS INTEGER) AS before, CAST(after AS INTEGER) AS after, accepted FROM done",
    "m05_order_stock": f"""WITH RECURSIVE {HISTORY}, e AS (SELECT goods_id, {_EFFECT} * number AS delta FROM done JOIN lin USING (order_id) WHERE accepted AND {_EFFECT} IS NOT NULL)
        SELECT goods_id, CAST(sum(greatest(-delta, 0)) AS BIGINT) AS taken, CAST(sum(greatest(delta, 0)) AS BIGINT) AS returned FROM e GROUP BY 1""",
    "m05_order_coupons": f"""WITH RECURSIVE {HISTORY}, e AS (SELECT order_id, nth, {_EFFECT} AS e FROM done WHERE accepted AND {_EFFECT} IS NOT NULL), l AS (SELECT order_id, arg_max(e, nth) AS last, count(*) FILTER (e = -1) AS n FROM e GROUP BY 1)
        SELECT ord.id + 7 AS coupon_id, ord.id AS order_id, CASE WHEN last = -1 THEN 'used' ELSE 'usable' END AS status, coalesce(n, 0) AS times_used FROM ord LEFT JOIN l ON l.order_id = ord.id""",
    "r20_index_hash": f"""WITH {UPDATED}, x AS (SELECT n_chunks, sha256(concat_ws(':', id, version, index_version)) AS h FROM indexed WHERE version IS NOT NULL),
        s AS (SELECT count(*) AS documents, CAST(sum(n_chunks) AS BIGINT) AS chunks, {', '.join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(4))} FROM x)
        SELECT documents, chunks, sha256(concat_ws(':', documents, s0, s1, s2, s3)) AS fingerprint FROM s""",
    "r21_update": f"WITH {UPDATED} SELECT id, change, CASE WHEN change IN ('same', 'gone') THEN NULL ELSE errors END AS errors, version, index_version, n_chunks FROM indexed",
    "f20_stock_guard": f"""WITH RECURSIVE {LIN}, m AS (SELECT goods_id, order_id * 10 + line_no AS id, CAST(CASE WHEN flag = 'R' THEN number ELSE -number END AS BIGINT) AS delta, row_number() OVER (PARTITION BY goods_id ORDER BY shipped, order_id * 10 + line_no) AS nth FROM lin),
        f AS (SELECT p_partkey AS goods_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS delta, CAST(p_size * 8 AS BIGINT) AS stock_left, true AS accepted FROM part
            UNION ALL SELECT m.goods_id, m.nth, m.id, m.delta, CASE WHEN stock_left + m.delta >= 0 THEN stock_left + m.delta ELSE stock_left END, stock_left + m.delta >= 0 FROM f JOIN m ON m.goods_id = f.goods_id AND m.nth = f.nth + 1)
        SELECT goods_id, id, delta, accepted, stock_left FROM f WHERE nth > 0""",
    "t01_patrol_stream": f"""WITH {ANA}, a AS (SELECT *, coalesce(label = 'negative', false) AS neg FROM ana)
        SELECT id AS analysis_id, 'negative_review' AS risk_type, 'high' AS risk_level, 'pending' AS status FROM a WHERE neg UNION ALL SELECT id, 'low_confidence', 'medium', 'pending' FROM a WHERE confidence < 0.6
        UNION ALL SELECT id, 'after_sales_risk', 'high', 'pending' FROM a WHERE negative_score >= 0.65 OR contains(text, 'clown') OR contains(text, 'hates') UNION ALL SELECT id, 'rating_conflict', 'medium', 'pending' FROM a WHERE rating <= 2 AND NOT neg""",
    "t01_patrol_ticks": f"""WITH {ANA}, a AS (SELECT *, coalesce(label = 'negative', false) AS neg, (row_number() OVER (ORDER BY id) - 1) // 400 + 1 AS tick FROM ana), r AS (
        SELECT id AS analysis_id, 'negative_review' AS risk_type, 'high' AS risk_level, tick FROM a WHERE neg UNION ALL SELECT id, 'low_confidence', 'medium', tick FROM a WHERE confidence < 0.6
        UNION ALL SELECT id, 'after_sales_risk', 'high', tick FROM a WHERE negative_score >= 0.65 OR contains(text, 'clown') OR contains(text, 'hates') UNION ALL SELECT id, 'rating_conflict', 'medium', tick FROM a WHERE rating <= 2 AND NOT neg)
        SELECT analysis_id, risk_type, risk_level, CAST(tick AS INTEGER) AS tick FROM r""",
    "t04_unpaid_stream": """WITH o AS (SELECT o_orderkey AS order_id, o_orderdate AS created, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(o_orderkey % 60) END AS paid FROM orders),
        e AS (SELECT order_id, 'created' AS kind, created AS ts, created + to_days(CASE WHEN order_id % 7 = 0 THEN 20 ELSE 0 END) AS arrives FROM o UNION ALL SELECT order_id, 'paid', paid, paid + to_days(CASE WHEN order_id % 50 = 0 THEN 1500 ELSE 0 END) FROM o WHERE paid IS NOT NULL),
        r AS (SELECT *, CASE WHEN arrives < TIMESTAMP '1997-01-01' THEN 1 WHEN arrives < TIMESTAMP '1999-01-01' THEN 2 ELSE 3 END AS run FROM e),
        w AS (SELECT n.run, coalesce(max(r.ts) - INTERVAL 30 DAY, TIMESTAMP '0001-01-01') AS mark FROM (SELECT unnest([1, 2, 3, 4]) AS run) n LEFT JOIN r ON r.run < n.run GROUP BY 1),
        k AS (SELECT r.order_id, min(ts) FILTER (kind = 'created') + INTERVAL 30 MINUTE AS due, min(ts) FILTER (kind = 'paid') AS paid FROM r JOIN w USING (run) WHERE ts >= mark GROUP BY 1)
        SELECT order_id, strftime(due, '%Y-%m-%d %H:%M') AS cancelled_at FROM k WHERE (paid IS NULL OR paid > due) AND due < (SELECT mark FROM w WHERE run = 4)""",
    "t05_ttl_idempotency": f"""WITH RECURSIVE {RUN}, u AS (SELECT user_id, created, min(id) AS id FROM run GROUP BY 1, 2),
        nxt AS (SELECT a.id, arg_min(b.id, b.created) AS later FROM u a JOIN u b ON a.user_id = b.user_id AND b.created > a.created + INTERVAL 900 SECOND GROUP BY 1),
        p(id) AS (SELECT arg_min(id, created) FROM u GROUP BY user_id UNION ALL SELECT nxt.later FROM p JOIN nxt USING (id)) SELECT id, id IN (SELECT id FROM p) AS processed FROM run""",
    "t10_daily_window": f"WITH {RUN} SELECT strftime(created, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (status = 'failed') AS failed FROM run GROUP BY 1",
    "s03_violations": """WITH d AS (SELECT CAST(doc_id % 900 AS VARCHAR) AS key, doc_id % 50 = 0 AS a, doc_id % 70 = 0 AS b FROM documents)
        SELECT key, 'missing source' AS problem FROM d WHERE a UNION ALL SELECT key, 'missing lang' FROM d WHERE b UNION ALL SELECT key, 'duplicate key' FROM d GROUP BY key HAVING count(*) > 1""",
    "s06_ingest_errors": f"""WITH p AS (SELECT page_id, regexp_extract(url, '[^?#]*') || {list(FILES)}[page_id % {len(FILES)} + 1] AS u, strlen(html) * CASE WHEN page_id % 11 = 0 THEN 5000 ELSE 1 END AS n FROM pages), x AS (SELECT *, lower(regexp_extract(u, '[^/.](\\.[^/.]*)$', 1)) AS e FROM p)
        SELECT page_id, concat_ws(',', CASE WHEN list_contains(string_split(u, '/'), '..') THEN 'PATH_TRAVERSAL_BLOCKED' END, CASE WHEN e IN ('.exe', '.bat', '.cmd', '.ps1', '.sh', '.js', '.vbs', '.zip', '.rar', '.7z') THEN 'FORBIDDEN_FILE_TYPE' END,
            CASE WHEN e NOT IN ('.txt', '.md', '.json', '.csv', '.pdf', '.docx') THEN 'UNSUPPORTED_FILE_TYPE' END, CASE WHEN n > 2000000 THEN 'FILE_TOO_LARGE' END, CASE WHEN e IN ('.exe', '.dll', '.com', '.bat', '.msi') THEN 'EXECUTABLE_MIME_BLOCKED' END) AS errors FROM x""",
    "s08_index_rollback": "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2",
    "s17_schema_evolution": "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS n_comment FROM nation",
}
