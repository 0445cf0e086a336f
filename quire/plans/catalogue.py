"""The registered queries of the engine's own operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import sequences, text
from quire.operators import detection, documents, filters, joins, kernels, layout, metrics, sampling, search, windows
from quire.plans import relations as rel
from quire.plans.base import ORACLE, QUERIES, query
from quire.plans.relations import AREA_A, AREA_B, CENTRE, HULL, INTER, IOU, TOUCH, fold_sql, with_sql
from quire.sources import labels
from quire.streaming import jobs

# Text and recognition


@query(with_sql("pairs") + """, p AS (SELECT lang, lower(regexp_replace(target, '[^0-9A-Za-z]', '', 'g')) a, lower(regexp_replace(found, '[^0-9A-Za-z]', '', 'g')) b FROM pairs)
SELECT lang, count(*) n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) matches, round(sum(CASE WHEN a = b THEN 1 ELSE 0 END) / (count(*) + 1e-5), 6) acc,
round(1 - sum(CASE WHEN greatest(length(a), length(b)) > 0 THEN levenshtein(a, b) / greatest(length(a), length(b)) ELSE 0.0 END) / (count(*) + 1e-5), 6) norm_edit_dis FROM p GROUP BY lang""")
def rec_accuracy_by_lang(spark, d):
    return metrics.recognition(rel.pairs(spark, d), ["lang"], "target", "found")


@query("SELECT conv_id, count(*) n_pages, string_agg(coalesce(text, ''), chr(10) || chr(12) ORDER BY turn, text) page_content FROM conversations GROUP BY conv_id")
def pages_concat(spark, d):
    return windows.concat_pages(rel.read(spark, d, "conversations"), "conv_id", "turn", "text")


_WIDE = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x20, 0x7F))).replace("'", "''")


@query(f"SELECT doc_id, translate(translate(text, 'abcxyz(),.', 'ａｂｃｘｙｚ（），．'), '{_WIDE}', '{_NARROW}') text, translate(translate(text, '{_NARROW}', '{_WIDE}'), '{_WIDE}', '{_NARROW}') = text same FROM documents")
def halfwidth(spark, d):
    """Whole texts with some letters, and with all printable ASCII, made full-width first."""
    some, every = F.translate("text", "abcxyz(),.", "ａｂｃｘｙｚ（），．"), F.translate("text", "".join(map(chr, range(0x20, 0x7F))), _WIDE)
    return rel.read(spark, d, "documents").select("doc_id", text.half_width(some).alias("text"), (text.half_width(every) == F.col("text")).alias("same"))


@query("SELECT page_id, regexp_replace(html, '([*`~$])', '\\\\\\1', 'g') escaped, replace(replace(url, '(', '%28'), ')', '%29') url FROM pages")
def md_escape(spark, d):
    return rel.read(spark, d, "pages").select("page_id", text.escape_markdown(F.col("html")).alias("escaped"), text.escape_url(F.col("url")).alias("url"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]*\\n[ \\t\\n]*', ' ', 'g'), '[ \\t]{2,}', ' ', 'g')) squashed,
regexp_replace(text, '<b>|</b>|<i>|</i>|<sup>|</sup>|<sub>|</sub>|<strike>|</strike>|<overline>|</overline>|<underline>|</underline>', '', 'g') = text AS plain FROM documents""")
def ws_squash(spark, d):
    return rel.read(spark, d, "documents").select("doc_id", text.squash_lines(F.col("text")).alias("squashed"), (text.strip_styles(F.col("text")) == F.col("text")).alias("plain"))


@query()
def script_text(spark, d):
    mixed = F.concat(F.substring("text", 1, 20), F.lit("سلام"), F.expr("substring(text, 21)"), F.lit(" مرحبا  بك"))
    return rel.read(spark, d, "documents").select("doc_id", text.script_spaces(mixed).alias("spaced"), text.is_rtl(mixed).alias("rtl"), text.visual_order(mixed).alias("visual"), text.squeeze_spaces(mixed).alias("squeezed"))


_CHARS = sequences.CHARACTERS


def _encode_sql(name: str, limit: int = 25) -> str:
    e = sequences.ENCODERS[name]
    base = len(e.before)
    known = f"list_transform(string_split(t, ''), lambda c: CASE WHEN strpos('{_CHARS}', c) > 0 THEN strpos('{_CHARS}', c) - 1 + {base} END)"
    found = f"list_transform({known}, lambda x: coalesce(x, {e.number(e.unknown)}))" if e.unknown else f"list_filter({known}, lambda x: x IS NOT NULL)"
    head, tail = (f"[{e.number(t)}]" if t else "CAST([] AS BIGINT[])" for t in (e.start, e.end))
    fits = f"length(t) BETWEEN 1 AND {limit} AND len(f) > 0 AND len(f) <= {limit - e.room}" if e.checks else "length(t) > 0 AND len(f) > 0"
    whole = f"list_concat(list_concat({head}, f), {tail})"
    padded = f"list_concat({whole}, list_transform(range(greatest(0, {limit + e.extra} - len({whole}))), lambda x: {e.number(e.pad)}))"
    return with_sql("lines", "bits") + f""", w AS (SELECT doc_id, line_no, piece, lower(bit) t FROM bits), n AS (SELECT *, {found} f FROM w)
SELECT doc_id, line_no, piece, CASE WHEN {fits} THEN array_to_string({f"{padded}[1:{limit + e.extra}]" if e.cut else padded}, ',') END ids FROM n"""


def _encoded(name: str) -> Callable:
    def run(spark, d):
        ids = sequences.encode(F.lower("bit"), sequences.ENCODERS[name])
        return rel.bits(spark, d).select("doc_id", "line_no", "piece", F.array_join(ids.cast("array<string>"), ",").alias("ids"))

    run.__name__ = f"encode_{name}"
    return run


for _name in sequences.ENCODERS:
    query(_encode_sql(_name))(_encoded(_name))


@query(with_sql("lines", "bits") + """, s AS (SELECT doc_id, line_no, piece, list_transform(string_split(lower(bit), ''), lambda c: CAST(strpos('0123456789abcdefghijklmnopqrstuvwxyz', c) AS BIGINT)) ids FROM bits),
k AS (SELECT doc_id, line_no, piece, list_filter(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN (i = 1 OR ids[i] <> ids[i - 1]) AND ids[i] <> 0 THEN {'x': ids[i], 's': (ids[i] * 7 + i) % 10 / 10.0} END), lambda x: x IS NOT NULL) kept FROM s)
SELECT doc_id, line_no, piece, array_to_string(list_transform(kept, lambda x: substring('0123456789abcdefghijklmnopqrstuvwxyz', CAST(x.x AS INT), 1)), '') AS text, round(CASE WHEN len(kept) > 0 THEN list_sum(list_transform(kept, lambda x: CAST(x.s AS DOUBLE))) / len(kept) ELSE 0.0 END, 6) AS score FROM k""")
def ctc_decode(spark, d):
    ids = F.transform(F.split(F.lower("bit"), ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.call_function("instr", F.lit(_CHARS), c)))
    steps = rel.bits(spark, d).select("doc_id", "line_no", "piece", ids.alias("ids")).withColumn("scores", F.transform("ids", lambda x, i: (x * 7 + i + 1) % 10 / 10.0))
    found, score = sequences.decode(F.col("ids"), F.col("scores"), sequences.Decoder(skip=(0,), repeats=True, empty=0.0), ["", *_CHARS])
    return steps.select("doc_id", "line_no", "piece", found.alias("text"), F.round(score, 6).alias("score"))


@query()
def word_groups(spark, d):
    @F.arrow_udf("string")
    def grouped(lines: pa.Array) -> pa.Array:
        return pa.array([" ".join(f"{w}/{k}" for w, k in documents.word_groups(x or "")) for x in lines.to_pylist()], pa.string())

    return rel.lines(spark, d).select("doc_id", "line_no", grouped("line").alias("words"))


@query("""WITH d AS (SELECT d.*, l.quality FROM documents d JOIN labels l USING (doc_id)), p AS (SELECT lang, quality, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END guess FROM d)
SELECT lang, count(*) n, CAST(sum(CASE WHEN quality = guess THEN 1 ELSE 0 END) AS BIGINT) correct, round(sum(CASE WHEN quality = guess THEN 1 ELSE 0 END) / (count(*) + 1e-5), 6) acc FROM p GROUP BY lang""")
def cls_accuracy(spark, d):
    rows = rel.read(spark, d, "documents").join(rel.read(spark, d, "labels"), "doc_id").withColumn("guess", (F.col("n_chars") > 300).cast("int"))
    return metrics.accuracy(rows, ["lang"], "quality", "guess")


_GRAMS = with_sql("pairs") + """, w AS (SELECT lang, doc_id, piece, list_filter(string_split(lower(regexp_replace(target, '[^0-9A-Za-z ]', '', 'g')), ' '), lambda x: x <> '') a, list_filter(string_split(lower(regexp_replace(found, '[^0-9A-Za-z ]', '', 'g')), ' '), lambda x: x <> '') b FROM pairs),
n AS (SELECT unnest(range(1, 5)) k),
t AS (SELECT lang, doc_id, piece, k, array_to_string(a[i:i + k - 1], ' ') gram, count(*) c FROM (SELECT *, unnest(range(1, len(a) - k + 2)) i FROM w, n WHERE len(a) >= k) GROUP BY ALL),
f AS (SELECT lang, doc_id, piece, k, array_to_string(b[i:i + k - 1], ' ') gram, count(*) c FROM (SELECT *, unnest(range(1, len(b) - k + 2)) i FROM w, n WHERE len(b) >= k) GROUP BY ALL),
s AS (SELECT f.lang, f.k AS size, CAST(sum(f.c) AS BIGINT) total, CAST(sum(least(f.c, coalesce(t.c, 0))) AS BIGINT) clipped FROM f LEFT JOIN t USING (lang, doc_id, piece, k, gram) GROUP BY f.lang, f.k)
"""


def _words(rows, *more):
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, "[^0-9A-Za-z ]", "")), " "), lambda x: x != "")
    return rows.select("lang", "doc_id", words("target").alias("a"), words("found").alias("b"), *more)


@query(_GRAMS + "SELECT lang, CAST(size AS INTEGER) size, total, clipped FROM s")
def ngram_overlap(spark, d):
    return metrics.ngram_overlap(_words(rel.pairs(spark, d)), ["lang"], "a", "b")


@query(_GRAMS + """, l AS (SELECT lang, sum(len(a)) tl, sum(len(b)) fl FROM w GROUP BY lang)
SELECT lang, round(CASE WHEN count(*) = 4 AND min(clipped) > 0 THEN CASE WHEN max(fl) / max(tl) > 1 THEN 1.0 ELSE exp(1 - max(tl) / max(fl)) END * exp(sum(ln(clipped / total)) / 4) ELSE 0.0 END, 6) bleu FROM s JOIN l USING (lang) GROUP BY lang""")
def bleu(spark, d):
    rows = _words(rel.pairs(spark, d))
    lengths = rows.groupBy("lang").agg(F.sum(F.size("a")).alias("truth_len"), F.sum(F.size("b")).alias("found_len"))
    return metrics.corpus_bleu(metrics.ngram_overlap(rows, ["lang"], "a", "b"), lengths, ["lang"])


@query()
def tokenize_13a(spark, d):
    return rel.read(spark, d, "documents").select("doc_id", F.array_join(metrics.tokens_13a(F.col("text")), " ").alias("tokens"))


@query()
def word_edit(spark, d):
    @F.arrow_udf("int")
    def far(truths: pa.Array, founds: pa.Array) -> pa.Array:
        return pa.array([text.edit_distance(a.as_py(), b.as_py()) for a, b in zip(truths, founds)], pa.int32())

    return _words(rel.misread(spark, d)).select("doc_id", far("a", "b").alias("edits"))


# Sampling and batches


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) k, round_even(count(*) OVER (PARTITION BY lang) * 0.25, 0) n FROM documents)
SELECT doc_id, lang FROM r WHERE k <= n""")
def ratio_sample(spark, d):
    return sampling.ratio_sample(rel.read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.25, 7)


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('10|' || doc_id), doc_id) AS place FROM documents")
def epoch_shuffle(spark, d):
    return sampling.epoch_shuffle(rel.read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 7, 3)


@query(with_sql("boxes") + """, b AS (SELECT box_id, CAST(floor((x1 - x0) / 16) AS BIGINT) w, CAST(floor((y1 - y0) / 8) AS BIGINT) h FROM boxes), r AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY w, h ORDER BY md5('0|' || box_id), box_id) - 1) / 16) AS BIGINT) batch FROM b)
SELECT box_id, w, h, batch FROM r QUALIFY count(*) OVER (PARTITION BY w, h, batch) = 16""")
def bucket_batches(spark, d):
    rows = rel.boxes(spark, d).select("box_id", F.floor((F.col("x1") - F.col("x0")) / 16).alias("w"), F.floor((F.col("y1") - F.col("y0")) / 8).alias("h"))
    return sampling.bucket_batches(rows, ["w", "h"], "box_id", 16, drop_short=True)


@query(with_sql("boxes") + """, p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY box_id) - 1 p FROM boxes), s AS (SELECT *, p % 2 scale, p // 2 k FROM p), t AS (SELECT *, CASE WHEN scale = 0 THEN 8 ELSE 3 END n, CASE WHEN scale = 0 THEN 320 ELSE 480 END w, CASE WHEN scale = 0 THEN 32 ELSE 48 END h FROM s)
SELECT label, CAST(scale AS INTEGER) scale, CAST(k // n AS BIGINT) batch, count(*) n, CAST(min(w) AS INTEGER) width, CAST(min(h) AS INTEGER) height, round(least(avg((x1 - x0) / (y1 - y0)), 10), 6) ratio FROM t GROUP BY label, scale, k // n""")
def multiscale_batches(spark, d):
    rows = rel.boxes(spark, d).withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    return sampling.scale_batches(rows, "label", "box_id", "w", "h", [(320, 32), (480, 48)], 320 * 32 * 8).withColumn("ratio", F.round("ratio", 6))


@query("""SELECT event_id, user_id, CAST(coalesce(CASE WHEN value >= 5 THEN event_id END, min(CASE WHEN value >= 5 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN value >= 5 THEN event_id END) OVER (PARTITION BY user_id)) AS BIGINT) used FROM events""")
def next_valid(spark, d):
    return sampling.next_valid(rel.read(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", F.col("value") >= 5, "event_id").drop("value")


# Joins of boxes


@query(with_sql("boxes", "cells") + f"SELECT a.page_id, a.box_id region, b.box_id line FROM cells a JOIN boxes b ON a.page_id = b.page_id AND {TOUCH}")
def region_overlap(spark, d):
    return joins.region_lines(rel.cells(spark, d), rel.boxes(spark, d)).select("page_id", F.col("l_box_id").alias("region"), F.col("r_box_id").alias("line"))


@query(with_sql("boxes", "pred") + f"SELECT a.page_id, a.box_id gt_id, b.box_id det_id, round({IOU}, 6) iou FROM boxes a JOIN pred b ON a.page_id = b.page_id AND {TOUCH} WHERE {IOU} >= 0.5")
def iou_pairs(spark, d):
    return joins.iou_pairs(rel.boxes(spark, d), rel.pred(spark, d)).select("page_id", F.col("l_box_id").alias("gt_id"), F.col("r_box_id").alias("det_id"), F.round("iou", 6).alias("iou"))


@query(with_sql("boxes", "pred") + f"SELECT b.page_id, b.box_id FROM pred b WHERE EXISTS (SELECT 1 FROM boxes a WHERE a.page_id = b.page_id AND a.label = 'R' AND ({INTER}) / {AREA_B} > 0.5 AND {TOUCH})")
def dont_care(spark, d):
    truth = rel.boxes(spark, d).withColumn("ignored", F.col("label") == "R")
    return joins.dont_care(truth, rel.pred(spark, d)).select("page_id", F.col("l_box_id").alias("box_id"))


@query(with_sql("boxes", "cells") + f"""SELECT page_id, line_id, cell_id, round(miss, 6) miss, round(dist, 6) dist FROM (SELECT a.page_id, b.box_id line_id, a.box_id cell_id, 1 - {IOU} miss,
abs(a.x0 - b.x0) + abs(a.y0 - b.y0) + abs(a.x1 - b.x1) + abs(a.y1 - b.y1) + least(abs(a.x0 - b.x0) + abs(a.y0 - b.y0), abs(a.x1 - b.x1) + abs(a.y1 - b.y1)) dist
FROM cells a JOIN boxes b ON a.page_id = b.page_id) QUALIFY row_number() OVER (PARTITION BY page_id, line_id ORDER BY miss, dist, cell_id) = 1""")
def nearest_cell(spark, d):
    return joins.nearest_cell(rel.boxes(spark, d), rel.cells(spark, d)).withColumns({"miss": F.round("miss", 6), "dist": F.round("dist", 6)})


@query(with_sql("boxes", "cells") + f"SELECT a.page_id, a.box_id cell_id, b.box_id line_id FROM cells a JOIN boxes b ON a.page_id = b.page_id AND {CENTRE}")
def centre_in_cell(spark, d):
    return joins.centre_in_cell(rel.cells(spark, d), rel.boxes(spark, d)).select("page_id", F.col("l_box_id").alias("cell_id"), F.col("r_box_id").alias("line_id"))


@query(with_sql("boxes", "cells") + f"""SELECT page_id, cell_id, line_id, round(far, 6) far FROM (SELECT a.page_id, a.box_id cell_id, b.box_id line_id, sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) * ((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) * ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2)) far
FROM cells a JOIN boxes b ON a.page_id = b.page_id) QUALIFY row_number() OVER (PARTITION BY page_id, cell_id ORDER BY far, line_id) = 1""")
def nearest_centre(spark, d):
    return joins.nearest_centre(rel.cells(spark, d), rel.boxes(spark, d)).withColumn("far", F.round("far", 6))


@query(with_sql("boxes", "cells") + f"SELECT b.page_id, b.box_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM cells a WHERE a.page_id = b.page_id AND a.box_id % 4 = 0 AND {CENTRE})")
def figure_exclusion(spark, d):
    return joins.outside_figures(rel.boxes(spark, d), rel.cells(spark, d).filter("box_id % 4 = 0")).select("page_id", F.col("l_box_id").alias("box_id"))


@query(with_sql("boxes", "cells") + f"SELECT b.page_id, b.box_id FROM boxes b WHERE EXISTS (SELECT 1 FROM cells a WHERE a.page_id = b.page_id AND a.box_id % 4 = 0 AND {CENTRE})")
def figure_lines(spark, d):
    return joins.inside_figures(rel.boxes(spark, d), rel.cells(spark, d).filter("box_id % 4 = 0")).select("page_id", F.col("l_box_id").alias("box_id"))


_OWNED = f"o AS (SELECT a.page_id, b.box_id line_id, min(a.box_id) cell_id FROM cells a JOIN boxes b ON a.page_id = b.page_id AND {CENTRE} WHERE a.box_id % 3 <> 0 GROUP BY a.page_id, b.box_id)"


def _owned(spark, d):
    return joins.cell_of_line(rel.cells(spark, d).filter("box_id % 3 <> 0"), rel.boxes(spark, d))


@query(with_sql("boxes", "cells") + f", {_OWNED} SELECT o.page_id, cell_id, string_agg(text, ' ' ORDER BY y0, x0, line_id) AS text, min(score) score, count(*) n FROM o JOIN boxes b ON o.page_id = b.page_id AND o.line_id = b.box_id GROUP BY o.page_id, cell_id")
def cell_text(spark, d):
    both = _owned(spark, d).join(rel.boxes(spark, d).withColumnRenamed("box_id", "line_id"), ["page_id", "line_id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "line_id", "text"))), lambda s: s["text"]), " ")
    return both.groupBy("page_id", "cell_id").agg(joined.alias("text"), F.min("score").alias("score"), F.count("*").alias("n"))


@query(with_sql("boxes", "cells") + f""", {_OWNED}, u AS (SELECT * FROM boxes WHERE (page_id, box_id) NOT IN (SELECT (page_id, line_id) FROM o))
SELECT a.page_id, a.box_id line_id, b.box_id cell_id, round({HULL}, 6) iou FROM u a JOIN cells b ON a.page_id = b.page_id AND {TOUCH} WHERE {HULL} > 0 AND b.box_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY a.page_id, a.box_id ORDER BY {HULL} DESC, b.box_id) = 1""")
def best_iou_of_rest(spark, d):
    return joins.best_iou_of_rest(rel.cells(spark, d).filter("box_id % 3 <> 0"), rel.boxes(spark, d), _owned(spark, d)).withColumn("iou", F.round("iou", 6))


@query(with_sql("boxes", "cells") + f""", {_OWNED}, u AS (SELECT * FROM boxes WHERE (page_id, box_id) NOT IN (SELECT (page_id, line_id) FROM o))
SELECT page_id, box_id line_id, CAST(39 + row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS BIGINT) cell_id FROM u""")
def virtual_cells(spark, d):
    rest = joins.unmatched(rel.boxes(spark, d), _owned(spark, d).withColumnRenamed("line_id", "box_id"), ["page_id", "box_id"])
    return joins.virtual_cells(rest, rel.cells(spark, d))


@query(with_sql("boxes") + """SELECT a.page_id, a.box_id, max(CASE WHEN b.x1 <= a.x0 THEN b.x1 END) left_limit, min(CASE WHEN b.x0 >= a.x1 THEN b.x0 END) right_limit FROM boxes a LEFT JOIN boxes b ON a.page_id = b.page_id AND a.box_id <> b.box_id
AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.4 * least(a.y1 - a.y0, b.y1 - b.y0) GROUP BY a.page_id, a.box_id""")
def neighbour_limits(spark, d):
    return joins.neighbour_limits(rel.boxes(spark, d))


@query("""WITH e AS (SELECT event_id place, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'insert' ELSE 'set' END action, user_id doc_id, event_type || event_id lang FROM events),
l AS (SELECT doc_id, arg_max(action, place) action, arg_max(lang, place) lang FROM e WHERE action <> 'insert' GROUP BY doc_id)
SELECT b.doc_id, coalesce(l.lang, b.lang) lang FROM documents b LEFT JOIN l USING (doc_id) WHERE l.action IS NULL OR l.action <> 'delete'
UNION ALL SELECT row_number() OVER (ORDER BY place) + (SELECT max(doc_id) FROM documents), lang FROM e WHERE action = 'insert'""")
def edit_merge(spark, d):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("set")
    edits = rel.read(spark, d, "events").select(F.col("event_id").alias("place"), kind.alias("action"), F.col("user_id").alias("doc_id"), F.concat("event_type", F.col("event_id").cast("string")).alias("lang"))
    return joins.edit_merge(rel.read(spark, d, "documents").select("doc_id", "lang"), edits, "doc_id", "lang")


@query("SELECT user_id AS tail, arg_min(event_id % 97, event_id) AS head FROM events GROUP BY user_id")
def first_link(spark, d):
    links = rel.read(spark, d, "events").select((F.col("event_id") % 97).alias("head"), F.col("user_id").alias("tail"), F.col("event_id").alias("place"))
    return joins.first_link(links)


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'missing' WHEN b.o_orderkey IS NULL THEN 'extra' WHEN abs(a.v - b.v) <= 1e-3 + 1e-3 * abs(b.v) THEN 'same' ELSE 'differs' END verdict
FROM (SELECT o_orderkey, o_totalprice v FROM orders WHERE o_orderkey % 10 <> 0) a FULL JOIN (SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 7 = 0 THEN 1.01 ELSE 1 END v FROM orders WHERE o_orderkey % 11 <> 0) b ON a.o_orderkey = b.o_orderkey""")
def golden_compare(spark, d):
    rows = rel.read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    golden = rows.filter("o_orderkey % 11 <> 0").withColumn("v", F.col("v") * F.when(F.col("o_orderkey") % 7 == 0, 1.01).otherwise(1.0))
    return joins.golden_compare(rows.filter("o_orderkey % 10 <> 0"), golden, ["o_orderkey"], "v")


@query("""WITH s AS (SELECT user_id chart_id, event_type series, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS BIGINT) place, event_id % 50 v FROM events), n AS (SELECT chart_id, unnest(list_sort(list(DISTINCT series))) series FROM s GROUP BY chart_id), p AS (SELECT DISTINCT chart_id, place FROM s)
SELECT p.chart_id, p.place, string_agg(coalesce(CAST(s.v AS VARCHAR), ''), '|' ORDER BY n.series) cells FROM p JOIN n USING (chart_id) LEFT JOIN s ON s.chart_id = p.chart_id AND s.place = p.place AND s.series = n.series GROUP BY p.chart_id, p.place""")
def series_table(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).cast("long")
    series = rel.read(spark, d, "events").select(F.col("user_id").alias("chart_id"), F.col("event_type").alias("series"), place.alias("place"), (F.col("event_id") % 50).alias("value"))
    return joins.series_table(series).withColumn("cells", F.array_join("cells", "|"))


@query(with_sql("boxes", "pred") + f"""SELECT a.page_id, a.box_id, round(coalesce({INTER} / nullif({AREA_A} + {AREA_B} - {INTER}, 0), 0), 6) by_union, round({INTER} / least({AREA_A}, {AREA_B}), 6) by_small, round({INTER} / greatest({AREA_A}, {AREA_B}), 6) by_large FROM boxes a JOIN pred b ON a.page_id = b.page_id AND a.box_id = b.box_id""")
def overlap_ratio_modes(spark, d):
    both = joins.on_page(rel.boxes(spark, d), rel.pred(spark, d), F.col("l_box_id") == F.col("r_box_id"))
    return both.select("page_id", F.col("l_box_id").alias("box_id"), *[F.round(g.overlap_ratio(joins.LEFT, joins.RIGHT, m), 6).alias(f"by_{m}") for m in ("union", "small", "large")])


@query(with_sql("boxes") + "SELECT page_id, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 FROM boxes GROUP BY page_id")
def enclosing_box(spark, d):
    found = rel.boxes(spark, d).groupBy("page_id").agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("p")).select("page_id", g.enclosing(F.col("p")).alias("b"))
    return found.select("page_id", *[F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query(with_sql("boxes") + """SELECT page_id, box_id, (x0 + x1) / 2 cx, (y0 + y1) / 2 cy, x1 - x0 w, y1 - y0 h, round((x1 - x0) * (y1 - y0) * 1.5 / (2 * (x1 - x0 + y1 - y0)), 6) unclip,
floor(least(greatest(x0, 0), 799)) clip_x0, floor(least(greatest(x1, 0), 799)) clip_x1 FROM boxes""")
def box_formats(spark, d):
    b = g.box()
    clip = g.clip_to(b, 800, 1000)
    cx, cy, w, h = g.to_xywh(b)
    return rel.boxes(spark, d).select("page_id", "box_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), F.round(g.unclip_distance(b, 1.5), 6).alias("unclip"), clip[0].cast("double").alias("clip_x0"), clip[2].cast("double").alias("clip_x1"))


# Kernels a page: matching, suppression, order, merging

_BOX = "page_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double"
_PLACED = "page_id long, box_id long, place long"


def _pairs(spark, d):
    pairs = joins.iou_pairs(rel.boxes(spark, d), rel.pred(spark, d), 0.3)
    return pairs.select("page_id", F.col("l_box_id").alias("gt_id"), F.col("r_box_id").alias("det_id"), "iou", (F.col("l_label") == "R").alias("ignored"))


def _kernel(name: str, kernel, schema: str, relation=rel.boxes, sql: str | None = None) -> None:
    def run(spark, d):
        out = kernels.per_page(relation(spark, d), kernel, schema)
        return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})

    run.__name__ = name
    query(sql)(run)


_MATCH = "page_id long, gt_id long, det_id long, iou double"
_PAIRS = f"SELECT a.page_id, a.box_id gt_id, b.box_id det_id, {IOU} iou, a.label = 'R' ignored FROM boxes a JOIN pred b ON a.page_id = b.page_id AND {TOUCH} WHERE {IOU} >= 0.3"
_FREE = "len(list_filter(a.acc, lambda x: x.g = b.gt_id OR x.d = b.det_id)) = 0"
_TAKE = "list_append(a.acc, {'g': b.gt_id, 'd': b.det_id, 'i': b.iou})"
_TAKEN = "STRUCT(g BIGINT, d BIGINT, i DOUBLE)[]"
_OUT = "page_id, unnest(acc).g AS gt_id, unnest(acc).d AS det_id, round(unnest(acc).i, 6) AS iou"
_MATCHED = (("boxes", "pred"), _PAIRS)
_kernel("match_iou_desc", kernels.match_by_iou, _MATCH, _pairs, fold_sql(*_MATCHED, "iou DESC, gt_id, det_id", f"CASE WHEN {_FREE} THEN {_TAKE} ELSE a.acc END", _TAKEN, _OUT))
_kernel("match_index_order", kernels.match_in_order, _MATCH, _pairs, fold_sql(*_MATCHED, "gt_id, det_id", f"CASE WHEN b.iou > 0.5 AND NOT b.ignored AND {_FREE} THEN {_TAKE} ELSE a.acc END", _TAKEN, _OUT))

_ROW = "STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, s DOUBLE, l VARCHAR)[]"
_THIS = "{'id': b.box_id, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 's': b.score, 'l': b.label}"
_SHARED = "greatest(least(x.x1, b.x1) - greatest(x.x0, b.x0), 0.0) * greatest(least(x.y1, b.y1) - greatest(x.y0, b.y0), 0.0)"
_MINE, _ITS = "(b.x1 - b.x0) * (b.y1 - b.y0)", "(x.x1 - x.x0) * (x.y1 - x.y0)"
_BOXES = (("boxes",), "SELECT * FROM boxes")
_ALL = "page_id, unnest(acc).id AS box_id, unnest(acc).x0 AS x0, unnest(acc).y0 AS y0, unnest(acc).x1 AS x1, unnest(acc).y1 AS y1, round(unnest(acc).s, 6) AS score"


def _kept_sql(order: str, bars: str) -> str:
    """A box stays unless one that stays already bars it."""
    return fold_sql(*_BOXES, order, f"CASE WHEN len(list_filter(a.acc, lambda x: {bars})) = 0 THEN list_append(a.acc, {_THIS}) ELSE a.acc END", _ROW, _ALL)


def _order_sql(near: int, floor: int) -> str:
    """Each box is put in front of the neighbours at the end of the list that it passes."""
    last = f"list_position(list_transform(list_reverse(a.acc[{floor + 1}:]), lambda x: abs(b.y0 - x.y0) < {near} AND b.x0 < x.x0), false)"
    cut = f"CASE WHEN len(a.acc) <= {floor} THEN len(a.acc) WHEN {last} IS NULL OR {last} = 0 THEN {floor} ELSE len(a.acc) - {last} + 1 END"
    return fold_sql(*_BOXES, "y0, x0, box_id", f"list_concat(list_append(a.acc[:{cut}], {_THIS}), a.acc[{cut} + 1:])", _ROW, "page_id, unnest(acc).id AS box_id, CAST(unnest(range(len(acc))) AS BIGINT) AS place")


# The mean of a row is that of its last box; a list element holds the row's number.
_LEVEL = fold_sql(*_BOXES, "(y0 + y1) / 2, x0, box_id", "list_append(a.acc, {'id': b.box_id, 'x': b.x0, 'm': (b.y0 + b.y1) / 2, 'line': CASE WHEN len(a.acc) = 0 THEN 0 WHEN abs((b.y0 + b.y1) / 2 - a.acc[-1].m) <= 0.6 * (b.y1 - b.y0) THEN a.acc[-1].line ELSE a.acc[-1].line + 1 END})",
                  "STRUCT(id BIGINT, x DOUBLE, m DOUBLE, line BIGINT)[]", "page_id, unnest(acc).id AS box_id, unnest(acc).line AS line, unnest(acc).x AS x")
_FIRST = "list_filter(a.acc, lambda x: x.lead AND abs(x.y - b.y0) < 3)"
_ROWS = fold_sql(*_BOXES, "y0, box_id", f"list_append(a.acc, {{'id': b.box_id, 'x': b.x0, 'y': b.y0, 'lead': len({_FIRST}) = 0, 'line': CASE WHEN len({_FIRST}) = 0 THEN len(list_filter(a.acc, lambda x: x.lead)) ELSE {_FIRST}[1].line END}})",
                 "STRUCT(id BIGINT, x DOUBLE, y DOUBLE, lead BOOLEAN, line BIGINT)[]", "page_id, unnest(acc).id AS box_id, unnest(acc).line AS line, unnest(acc).x AS x")
_IN_LINE = "SELECT page_id, box_id, line, CAST(row_number() OVER (PARTITION BY page_id, line ORDER BY x, box_id) - 1 AS BIGINT) AS place FROM ({}) placed"


def _lines_sql(folded: str) -> str:
    head, select = folded.rsplit("\nSELECT ", 1)
    return f"{head}\n{_IN_LINE.format('SELECT ' + select)}"


_kernel("hard_nms", kernels.hard_nms, _BOX, sql=_kept_sql("score DESC, box_id", f"x.l = b.label AND ({_SHARED}) / ({_MINE} + {_ITS} - {_SHARED} + 1e-5) > 0.5"))
_kernel("soft_nms", kernels.soft_nms, _BOX)
_kernel("locality_nms", kernels.locality_nms, _BOX)
_kernel("label_dedup", lambda rows: kernels.label_dedup(rows, first="A"), _BOX, sql=_kept_sql("label <> 'A', score DESC, box_id", f"({_SHARED}) / least({_MINE}, {_ITS}) > 0.5"))
_kernel("reading_order", kernels.reading_order, _PLACED, sql=_order_sql(10, 0))
_kernel("kie_order", lambda rows: kernels.reading_order(rows, 20, 1), _PLACED, sql=_order_sql(20, 1))
_kernel("two_column_order", lambda rows: kernels.two_columns(rows, rel.WIDE), _PLACED)
_kernel("row_order", kernels.level_rows, "page_id long, box_id long, line long, place long", sql=_lines_sql(_LEVEL))
_kernel("rtl_order", lambda rows: kernels.level_rows(rows, running=True, rtl=True), "page_id long, box_id long, line long, place long")
_kernel("table_rows", kernels.table_rows, "page_id long, box_id long, line long, place long", sql=_lines_sql(_ROWS))
_kernel("line_merge", kernels.merge_words, _BOX + ", text string")
_kernel("fragment_merge", kernels.merge_fragments, _BOX)


# Metrics over matches


_CARE = f"d AS (SELECT b.page_id, b.box_id, b.score, b.x0, b.y0, b.x1, b.y1 FROM pred b WHERE NOT EXISTS (SELECT 1 FROM boxes a WHERE a.page_id = b.page_id AND a.label = 'R' AND {TOUCH} AND ({INTER}) / {AREA_B} > 0.5))"


def _detection_sql(least: str) -> str:
    """Matches by a fold, in index order, of truth that counts with found boxes that count, for each least score."""
    rows = f"SELECT t.threshold, a.page_id, a.box_id gt_id, b.box_id det_id, {IOU} iou FROM boxes a JOIN d b ON a.page_id = b.page_id AND {TOUCH} JOIN t ON round(b.score, 4) >= t.threshold WHERE a.label <> 'R' AND {IOU} > 0.5"
    folded = fold_sql(("boxes", "pred"), rows, "gt_id, det_id", f"CASE WHEN {_FREE} THEN {_TAKE} ELSE a.acc END", _TAKEN, "threshold, page_id, len(acc) AS hits", "threshold, page_id")
    head, select = folded.rsplit("\nSELECT ", 1)
    head = head.replace(", rows AS (", f", t AS (SELECT CAST(unnest({least}) AS DOUBLE) / 10 AS threshold), {_CARE}, rows AS (", 1)
    return f"""{head}, m AS (SELECT threshold, sum(hits) AS hit FROM (SELECT {select}) h GROUP BY threshold),
c AS (SELECT threshold, count(*) AS det FROM d JOIN t ON round(score, 4) >= threshold GROUP BY threshold), g AS (SELECT count(*) AS gt FROM boxes WHERE label <> 'R'),
s AS (SELECT threshold, CAST(coalesce(hit, 0) AS BIGINT) AS matched, CAST(coalesce(det, 0) AS BIGINT) AS det_care, CAST(gt AS BIGINT) AS gt_care, coalesce(hit / nullif(det, 0), 0.0) AS p, coalesce(hit / nullif(gt, 0), 0.0) AS r FROM t LEFT JOIN m USING (threshold) LEFT JOIN c USING (threshold), g)
SELECT threshold, matched, det_care, gt_care, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS hmean FROM s"""


def _detection(spark, d, least):
    truth = rel.boxes(spark, d).withColumn("ignored", F.col("label") == "R")
    return detection.at_thresholds(truth, rel.pred(spark, d).withColumn("score", F.round("score", 4)), least)


@query(_detection_sql("[0]"))
def det_prh(spark, d):
    return _detection(spark, d, [0.0])


@query(_detection_sql("[3, 4, 5, 6, 7, 8, 9]"))
def det_prh_thresholds(spark, d):
    return _detection(spark, d, [k / 10 for k in range(3, 10)])


@query(with_sql("boxes", "pred") + """, c AS (SELECT CASE a.label WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 4 END t, CASE b.label WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 4 END f FROM boxes a JOIN pred b USING (box_id)),
s AS (SELECT t AS label, 1 nt, 0 nf, CASE WHEN t = f THEN 1 ELSE 0 END h FROM c UNION ALL SELECT f, 0, 1, 0 FROM c)
SELECT label, CAST(sum(nt) AS BIGINT) n_truth, CAST(sum(nf) AS BIGINT) n_found, CAST(sum(h) AS BIGINT) hit, round(2 * sum(h) / greatest(sum(nt) + sum(nf), 1), 6) f1 FROM s WHERE label NOT IN (3) GROUP BY label""")
def kie_f1(spark, d):
    number = lambda c: F.when(F.col(c) == "A", 1).when(F.col(c) == "N", 2).when(F.col(c) == "R", 3).otherwise(4)
    both = rel.boxes(spark, d).select("box_id", number("label").alias("t")).join(rel.pred(spark, d).select("box_id", number("label").alias("f")), "box_id")
    return metrics.node_f1(both, "t", "f", [3])


_TAGS = "t AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'O' WHEN event_id % 3 = 0 THEN 'B-' || event_type ELSE 'I-' || event_type END tag FROM events)"
_SPANS = f"""{_TAGS}, b AS (SELECT user_id, event_id, tag, substring(tag, 3) label, lag(CASE WHEN tag = 'O' THEN '' ELSE substring(tag, 3) END, 1, '') OVER (PARTITION BY user_id ORDER BY event_id) pl FROM t),
s AS (SELECT *, sum(CASE WHEN tag <> 'O' AND (tag LIKE 'B%' OR pl <> label) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) span FROM b)
"""


def _tags(spark, d):
    kind = F.when(F.col("event_type") == "error", "O").when(F.col("event_id") % 3 == 0, F.concat(F.lit("B-"), "event_type")).otherwise(F.concat(F.lit("I-"), "event_type"))
    return rel.read(spark, d, "events").select("user_id", "event_id", kind.alias("tag"))


@query(f"WITH {_SPANS} SELECT user_id, label, min(event_id) AS \"first\", max(event_id) AS \"last\" FROM s WHERE tag <> 'O' GROUP BY user_id, span, label")
def entity_spans(spark, d):
    return metrics.entity_spans(_tags(spark, d), "user_id", "event_id", "tag")


@query("""WITH a AS (SELECT DISTINCT user_id, event_type, event_id % 20 k FROM events WHERE event_id % 4 <> 0), b AS (SELECT DISTINCT user_id, event_type, event_id % 20 k FROM events WHERE event_id % 5 <> 0),
j AS (SELECT coalesce(a.user_id, b.user_id) user_id, a.user_id t, b.user_id f FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.k = b.k),
c AS (SELECT user_id, CAST(count(*) FILTER (t IS NOT NULL AND f IS NOT NULL) AS BIGINT) tp, CAST(count(*) FILTER (t IS NULL) AS BIGINT) fp, CAST(count(*) FILTER (f IS NULL) AS BIGINT) fn FROM j GROUP BY user_id)
SELECT user_id, tp, fp, fn, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0.0 END, 6) f1 FROM c""")
def relation_f1(spark, d):
    rows = rel.read(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 20).alias("k"), "event_id")
    return metrics.set_f1(rows.filter("event_id % 4 <> 0"), rows.filter("event_id % 5 <> 0"), "user_id", ["event_type", "k"])


@query("SELECT user_id, event_type, CAST(c AS BIGINT) votes FROM (SELECT user_id, event_type, count(*) c FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) = 1")
def segment_vote(spark, d):
    return metrics.segment_vote(rel.read(spark, d, "events"), "user_id", "event_type")


@query(with_sql("boxes") + "SELECT page_id, h AS median FROM (SELECT page_id, y1 - y0 h, row_number() OVER (PARTITION BY page_id ORDER BY y1 - y0) r, count(*) OVER (PARTITION BY page_id) n FROM boxes WHERE y1 - y0 > 0) WHERE r = n // 2 + 1")
def upper_median_height(spark, d):
    return metrics.upper_median(rel.boxes(spark, d), "page_id", F.col("y1") - F.col("y0"))


@query(with_sql("boxes") + """, h AS (SELECT page_id, CAST(round_even(x0 / 7.0, 0) AS BIGINT) k, count(*) n FROM boxes GROUP BY ALL)
SELECT page_id, k, n, CAST(near AS BIGINT) near FROM (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY k RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) near FROM h) WHERE near > 1""")
def edge_histogram(spark, d):
    return metrics.band_edges(metrics.edge_histogram(rel.boxes(spark, d), "page_id", "x0", 7.0), "page_id")


@query("""WITH l AS (SELECT user_id, event_id, 'step ips: ' || CAST(event_id % 100 AS VARCHAR) line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r FROM events WHERE event_type = 'view')
SELECT user_id, count(*) n, round(avg(event_id % 100), 6) AS avg, CAST(min(event_id % 100) AS DOUBLE) AS min, CAST(max(event_id % 100) AS DOUBLE) AS max FROM l WHERE r > 2 GROUP BY user_id""")
def log_throughput(spark, d):
    lines = rel.read(spark, d, "events").withColumn("line", F.when(F.col("event_type") == "view", F.concat(F.lit("step ips: "), (F.col("event_id") % 100).cast("string"))).otherwise(F.lit("other")))
    return metrics.log_throughput(lines, "user_id", "event_id", "line", "ips:", 2)


@query()
def deteval(spark, d):
    both = rel.boxes(spark, d).withColumn("side", F.lit(0)).unionByName(rel.pred(spark, d).withColumn("side", F.lit(1)))

    def page(rows):
        out = kernels.deteval([r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1])
        return [out | {"page_id": rows[0]["page_id"]}]

    found = kernels.per_page(both, page, "page_id long, recall_sum double, precision_sum double, n_truth long, n_found long")
    return found.withColumns({c: F.round(c, 6) for c in ("recall_sum", "precision_sum")})


# Windows


@query("SELECT event_id, event_type, round(median(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) median FROM events")
def sliding_median(spark, d):
    return windows.sliding_median(rel.read(spark, d, "events"), "event_type", "event_id", "value", 5).select("event_id", "event_type", "median")


@query(with_sql("boxes") + """, c AS (SELECT page_id, x0, sum(CASE WHEN p IS NOT NULL AND x0 - p <= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT page_id, x0, lag(x0) OVER (PARTITION BY page_id ORDER BY x0) p FROM boxes))
SELECT page_id, CAST(cluster AS BIGINT) AS cluster, count(*) n, round(avg(x0), 6) centre FROM c GROUP BY page_id, cluster""")
def cluster_values(spark, d):
    # Equal values are one step apart of nothing, so the frame by value and that by row agree on clusters.
    return windows.cluster_values(rel.boxes(spark, d), "page_id", "x0", 12.0)


@query("""WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END b FROM events), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) run FROM m)
SELECT user_id, CAST(run AS BIGINT) run, event_type, count(*) n, string_agg(CAST(event_id AS VARCHAR), '' ORDER BY event_id) AS text FROM r GROUP BY user_id, run, event_type""")
def typographic_runs(spark, d):
    return windows.typographic_runs(rel.read(spark, d, "events").withColumn("t", F.col("event_id").cast("string")), "user_id", "event_id", ["event_type"], "t")


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 2 END lvl FROM events), s AS (SELECT *, sum(CASE WHEN lvl IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) st FROM l)
SELECT user_id, event_id, CAST(CASE WHEN lvl IS NOT NULL THEN row_number() OVER (PARTITION BY user_id, st, lvl ORDER BY event_id) END AS INTEGER) number FROM s""")
def list_numbering(spark, d):
    rows = rel.read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_id") % 2).alias("lvl"))
    return windows.list_numbers(rows, "user_id", "event_id", "lvl").drop("lvl")


@query("""WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END b FROM events), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) run FROM m),
p AS (SELECT user_id, run, string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id) t FROM r GROUP BY user_id, run) SELECT user_id, count(*) n_parts, string_agg(t, chr(10) || chr(10) ORDER BY run) AS text FROM p GROUP BY user_id""")
def grouped_parts(spark, d):
    return windows.grouped_parts(rel.read(spark, d, "events").withColumn("t", F.col("event_id").cast("string")), "user_id", "event_id", "event_type", "t")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN '--' ELSE event_type END t FROM events), h AS (SELECT *, min(CASE WHEN t <> '--' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) nx,
max(CASE WHEN t <> '--' THEN event_id END) OVER (PARTITION BY user_id) la, min(event_id) OVER (PARTITION BY user_id) fi FROM e) SELECT user_id, coalesce(nx, la, fi) home, string_agg(t, '' ORDER BY event_id) AS text, count(*) n FROM h GROUP BY user_id, coalesce(nx, la, fi)""")
def marker_folding(spark, d):
    rows = rel.read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "--").otherwise(F.col("event_type")).alias("t"))
    return windows.fold_markers(rows, "user_id", "event_id", "t")


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN '12' WHEN 'view' THEN ') a' ELSE event_type END t FROM events), w AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY event_id) nx, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) pv FROM e)
SELECT user_id, event_id, CASE WHEN t = '12' AND nx = ') a' THEN t || nx ELSE t END merged FROM w WHERE NOT (coalesce(pv = '12', false) AND t = ') a')""")
def header_merge(spark, d):
    line = F.when(F.col("event_type") == "error", "12").when(F.col("event_type") == "view", ") a").otherwise(F.col("event_type"))
    return windows.merge_headers(rel.read(spark, d, "events").select("user_id", "event_id", line.alias("t")), "user_id", "event_id", "t").drop("t")


@query(with_sql("boxes") + """, f AS (SELECT *, (x1 - x0) >= (max(x1) OVER (PARTITION BY page_id) - min(x0) OVER (PARTITION BY page_id)) / 1 - (y1 - y0) AS fl FROM boxes), g AS (SELECT *, lag(fl) OVER (PARTITION BY page_id ORDER BY box_id) pf FROM f),
p AS (SELECT *, sum(CASE WHEN coalesce(pf, false) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY box_id) paragraph FROM g) SELECT page_id, CAST(paragraph AS BIGINT) paragraph, count(*) n, string_agg(text, ' ' ORDER BY box_id) AS text FROM p GROUP BY page_id, paragraph""")
def paragraphs(spark, d):
    return windows.paragraphs(rel.boxes(spark, d), "page_id", "box_id", "x0", "x1", "y0", "y1", "text")


# Documents, JSON, inputs


@query()
def html_blocks(spark, d):
    return rel.regions(spark, d)


@query()
def markdown_render(spark, d):
    return documents.render_regions(rel.regions(spark, d), "page_id", "place")


@query()
def teds(spark, d):
    """Each order as a table, a row a line, against one with a cell misread in every third line and the last line missing in every second order."""
    row = lambda flag: F.concat(F.lit("<tr><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), flag, F.lit("</td><td>"), F.col("l_linestatus"), F.lit("</td></tr>"))
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.lit("?")).otherwise(F.col("l_returnflag"))
    lines = rel.read(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", row(F.col("l_returnflag")).alias("truth"), row(shown).alias("found")).alias("r"))
    tables = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("r"))
    whole = lambda rows: F.concat(F.lit("<html><body><table>"), F.array_join(rows, ""), F.lit("</table></body></html>"))
    found = F.when(F.col("l_orderkey") % 2 == 0, F.slice("r.found", 1, F.greatest(F.size("r") - 1, F.lit(1)))).otherwise(F.col("r.found"))
    return tables.select(F.col("l_orderkey").alias("order_id"), F.round(documents.teds(whole(found), whole(F.col("r.truth"))), 6).alias("teds"))


@query("""SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'error' THEN 'no jobId' WHEN event_type = 'view' THEN 'unknown state' END AS problem FROM events""")
def envelope_check(spark, d):
    state = F.when(F.col("event_type") == "view", "odd").otherwise(F.lit("running"))
    answer = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.when(F.col("event_type") != "error", F.col("event_id")).alias("jobId"), state.alias("state")).alias("data")))
    return rel.read(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), labels.envelope(answer).alias("problem"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'url' WHEN page_id % 4 = 1 THEN 'base64' WHEN page_id % 4 = 2 THEN 'path' ELSE 'relative' END kind FROM pages")
def input_kind(spark, d):
    value = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.base64(F.col("html").cast("binary"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("/data/"), "page_id")).otherwise(F.lit("a/b.png"))
    return rel.read(spark, d, "pages").select("page_id", labels.input_kind(F.regexp_replace(value, r"\s", "")).alias("kind"))


@query(with_sql("boxes") + "SELECT page_id, count(*) n, CAST(sum(CASE WHEN label = 'R' THEN 1 ELSE 0 END) AS BIGINT) n_ignored FROM boxes GROUP BY page_id")
def label_json_parse(spark, d):
    corner = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    box = F.struct(F.when(F.col("label") == "R", "###").otherwise(F.col("text")).alias("transcription"), corner.alias("points"))
    files = rel.boxes(spark, d).groupBy("page_id").agg(F.to_json(F.collect_list(box)).alias("label"))
    parsed = labels.detection_labels(files)
    return parsed.select("page_id", F.size("boxes").cast("long").alias("n"), F.size(F.filter("boxes", lambda b: b["ignored"])).cast("long").alias("n_ignored"))


@query("""SELECT conv_id, string_agg(trim(t), chr(10) ORDER BY turn, t) AS text, round(avg(s), 6) confidence, count(*) n_lines FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') t, (turn % 5) / 4.0 s FROM conversations) WHERE trim(t) <> '' GROUP BY conv_id""")
def api_page_flatten(spark, d):
    line = F.regexp_replace("text", r"\s+", " ")
    turns = rel.read(spark, d, "conversations").select("conv_id", F.struct("turn", line.alias("t"), ((F.col("turn") % 5) / 4).alias("s")).alias("x"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("l"))
    result = F.struct(F.struct(F.array(F.struct(F.struct(F.col("l.t").alias("rec_texts"), F.col("l.s").alias("rec_scores")).alias("prunedResult"))).alias("ocrResults")).alias("result"))
    pages = labels.pages_of(rows.select("conv_id", F.to_json(result).alias("value")))
    out = labels.page_summary(pages, ["conv_id"])
    return out.select("conv_id", "text", F.round("confidence", 6).alias("confidence"), F.col("n_lines").cast("long").alias("n_lines"))


@query(with_sql("boxes") + "SELECT page_id, box_id, round(score, 2) AS score, CASE WHEN score < 0.7 THEN 'low' WHEN score < 0.9 THEN 'medium' ELSE 'high' END AS flag, CAST(rank() OVER (PARTITION BY page_id ORDER BY round(score, 2), box_id) AS INTEGER) place FROM boxes WHERE score < 0.95")
def review_queue(spark, d):
    from pyspark.sql import Window

    rows = rel.boxes(spark, d).filter("score < 0.95").withColumn("flag", F.when(F.col("score") < 0.7, "low").when(F.col("score") < 0.9, "medium").otherwise("high")).withColumn("score", F.round("score", 2))
    return rows.select("page_id", "box_id", "score", "flag", F.row_number().over(Window.partitionBy("page_id").orderBy("score", "box_id")).alias("place"))


@query("""WITH q AS (SELECT vec_id q, embedding qe FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) sc FROM q, embeddings WHERE vec_id <> q)
SELECT q AS query_id, vec_id, round(sc, 6) score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY sc DESC, vec_id) <= 5""")
def vector_topk(spark, d):
    """The stated queries (ids divisible by 50), sent to every row in blocks: a top-5 report."""
    rows = rel.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return search.exact_top(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "e", 5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


# States and windows of events

_STATE = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


@query(f"""WITH j AS (SELECT user_id job_id, ts, event_id, {_STATE} state FROM events), b AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY ts, event_id) p, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) r FROM j)
SELECT job_id, max(CASE WHEN r = 1 THEN state END) state, count(*) n, CAST(sum(CASE WHEN p IS NOT NULL AND p <> state THEN 1 ELSE 0 END) AS BIGINT) changes FROM b GROUP BY job_id""")
def job_states(spark, d):
    return jobs.job_states(rel.read(spark, d, "events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return jobs.event_windows(rel.read(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return jobs.sessions(rel.read(spark, d, "events"))


# Layout


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w), 64)) s FROM t)
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(len(w[s + 1:s + 64]) AS INTEGER) AS size, w[s + 1] AS head FROM c""")
def token_chunks(spark, d):
    rows = rel.read(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return layout.token_chunks(rows, "w", 64).select("doc_id", "start", F.size("chunk").alias("size"), F.get("chunk", F.lit(0)).alias("head"))


@query(with_sql("boxes") + """, m AS (SELECT page_id, h AS med FROM (SELECT page_id, y1 - y0 h, row_number() OVER (PARTITION BY page_id ORDER BY y1 - y0) r, count(*) OVER (PARTITION BY page_id) n FROM boxes WHERE y1 - y0 > 0) WHERE r = n // 2 + 1),
k AS (SELECT b.page_id, box_id, med, x0, x1 - x0 w, length(text) n, (y1 - y0) / med q, [0.8, 1.0, 1.45, 1.9, 2.4] rungs FROM boxes b JOIN m USING (page_id))
SELECT page_id, box_id, round(least(med * list_sort(list_transform(rungs, lambda r: {'far': abs(CAST(r AS DOUBLE) - q), 'rung': CAST(r AS DOUBLE)}))[1].rung, w / (n * CAST(0.34 AS DOUBLE))), 6) font, round_even(x0 / 9.0, 0) * 9 AS indent FROM k""")
def font_sizes(spark, d):
    rows = rel.boxes(spark, d)
    both = rows.join(metrics.upper_median(rows, "page_id", F.col("y1") - F.col("y0")), "page_id")
    size = layout.font_size(F.col("y1") - F.col("y0"), F.col("median"), F.col("x1") - F.col("x0"), F.length("text"))
    return both.select("page_id", "box_id", F.round(size, 6).alias("font"), layout.indent(F.col("x0")).alias("indent"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN strftime(DATE '1899-12-30' + CAST(p_size * 900 AS INTEGER), '%Y-%m-%d') ELSE CAST(p_size AS VARCHAR) END AS shown FROM part")
def excel_dates(spark, d):
    even = F.col("p_size") % 2 == 0
    return rel.read(spark, d, "part").select("p_partkey", layout.excel_date(F.when(even, F.col("p_size") * 900).otherwise(F.col("p_size")), F.when(even, "YYYY-MM").otherwise("0.00")).alias("shown"))


@query("""WITH s AS (SELECT CAST(p_partkey AS BIGINT) p_partkey, 600 + p_size * 20 w, 400 + p_size * 10 h FROM part)
SELECT p_partkey, CAST(y AS INTEGER) tile_y, CAST(x AS INTEGER) tile_x FROM (SELECT p_partkey, w, unnest(range(0, greatest(h - 320 + 256, 256), 256)) y FROM s), LATERAL (SELECT unnest(range(0, greatest(w - 320 + 256, 256), 256)) x)""")
def image_tiles(spark, d):
    rows = rel.read(spark, d, "part").select("p_partkey", (600 + F.col("p_size") * 20).alias("w"), (400 + F.col("p_size") * 10).alias("h"))
    return layout.tiles(rows, "w", "h", 320, 256).select("p_partkey", "tile_y", "tile_x")


@query()
def bilingual_merge(spark, d):
    """Two readings of each turn: one with Arabic words put in on every second."""
    rows = rel.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.col("text"), ((F.col("turn") % 4) / 4).alias("score"))
    other = rows.filter("line_no % 3 <> 0").withColumn("text", F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("سلام "), F.col("text"))).otherwise(F.col("text")))
    return layout.merge_bilingual(other.withColumn("score", F.lit(0.4)), rows)


# Filters and cuts


@query(with_sql("boxes") + "SELECT page_id, box_id, score FROM boxes WHERE score >= 0.75")
def score_filter(spark, d):
    return filters.by_score(rel.boxes(spark, d), 0.75).select("page_id", "box_id", "score")


@query(with_sql("boxes") + """, c AS (SELECT page_id, box_id, CAST(trunc(least(greatest(x0 - 20, 0.0), 799.0)) AS BIGINT) x0, CAST(trunc(least(greatest(y0 - 10, 0.0), 999.0)) AS BIGINT) y0,
CAST(trunc(least(greatest(x1 - 20, 0.0), 799.0)) AS BIGINT) x1, CAST(trunc(least(greatest(y1 - 10, 0.0), 999.0)) AS BIGINT) y1 FROM boxes) SELECT * FROM c WHERE x1 - x0 > 3 AND y1 - y0 > 3""")
def clipped_boxes(spark, d):
    moved = rel.boxes(spark, d).withColumns({"x0": F.col("x0") - 20, "x1": F.col("x1") - 20, "y0": F.col("y0") - 10, "y1": F.col("y1") - 10})
    return filters.clipped(moved, 800, 1000).select("page_id", "box_id", "x0", "y0", "x1", "y1")


@query(with_sql("boxes", "cells") + "SELECT b.page_id, b.box_id FROM boxes b JOIN (SELECT page_id, min(y0) t FROM cells WHERE box_id >= 10 + page_id % 20 GROUP BY page_id) c USING (page_id) WHERE b.y1 >= c.t")
def above_table(spark, d):
    return filters.not_above(rel.boxes(spark, d), rel.cells(spark, d).filter("box_id >= 10 + page_id % 20")).select("page_id", "box_id")


@query("SELECT doc_id, lang, CAST(list_position(['en', 'de', 'fr'], lang) - 1 AS BIGINT) AS class FROM documents WHERE list_position(['en', 'de', 'fr'], lang) > 0")
def class_label(spark, d):
    return rel.read(spark, d, "documents").select("doc_id", "lang", filters.class_index(F.col("lang"), ["en", "de", "fr"]).alias("class")).filter("class is not null")


@query(with_sql("boxes") + """, a AS (SELECT * FROM boxes WHERE score > 0.62 QUALIFY row_number() OVER (PARTITION BY page_id, label ORDER BY score DESC, box_id) <= 8)
SELECT page_id, box_id, label, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, box_id) AS INTEGER) AS rank FROM a QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, box_id) <= 15""")
def candidate_topk(spark, d):
    return filters.top_candidates(rel.boxes(spark, d), 8, 15, 0.62).select("page_id", "box_id", "label", "rank")


@query(with_sql("boxes") + "SELECT page_id, box_id FROM boxes QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY box_id) <= 10")
def contour_cap(spark, d):
    return filters.first_of_page(rel.boxes(spark, d), 10).select("page_id", "box_id")


@query(with_sql("boxes") + "SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y0, box_id) AS INTEGER) AS place FROM boxes")
def top_order(spark, d):
    return filters.by_top(rel.boxes(spark, d)).select("page_id", "box_id", "place")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) s FROM embeddings) SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS class, round(list_max(s), 6) AS score FROM e""")
def cls_decode(spark, d):
    best, score = filters.best_class(F.col("embedding").cast("array<double>"))
    return rel.read(spark, d, "embeddings").select("vec_id", best.alias("class"), F.round(score, 6).alias("score"))


@query(with_sql("boxes") + """, s AS (SELECT box_id, CAST((x1 - x0) * 12 AS BIGINT) w, CAST((y1 - y0) * 7 AS BIGINT) h FROM boxes)
SELECT box_id, CAST(ceil(w / 16) * 16 AS BIGINT) AS wide, CAST(ceil(h / 16) * 16 AS BIGINT) AS high FROM s WHERE w BETWEEN 32 AND 672 AND h BETWEEN 32 AND 192""")
def formula_buckets(spark, d):
    wide, high = filters.formula_bucket(((F.col("x1") - F.col("x0")) * 12).cast("long"), ((F.col("y1") - F.col("y0")) * 7).cast("long"))
    return rel.boxes(spark, d).select("box_id", wide.alias("wide"), high.alias("high")).filter("wide is not null")


@query(with_sql("boxes") + """SELECT box_id, CAST(CAST(x0 AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y0 AS BIGINT) AS VARCHAR) || ';' || CAST(CAST(x1 AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y0 AS BIGINT) AS VARCHAR) || ';'
|| CAST(CAST(x1 AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y1 AS BIGINT) AS VARCHAR) || ';' || CAST(CAST(x0 AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y1 AS BIGINT) AS VARCHAR) AS points, text || ', ' || label AS text FROM boxes""")
def csv_labels(spark, d):
    number = lambda c: F.concat(F.lit('"'), F.col(c).cast("long").cast("string"), F.lit('"'))
    line = F.concat(F.lit("﻿"), F.concat_ws(", ", *map(number, ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1"))), F.lit(', "'), F.col("text"), F.lit(", "), F.col("label"), F.lit('"'))
    points, found = filters.csv_label(line)
    return rel.boxes(spark, d).select("box_id", F.array_join(F.transform(points, lambda p: F.array_join(p.cast("array<string>"), " ")), ";").alias("points"), found.alias("text"))


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 3 > 0 THEN 8 + CAST(floor(value) AS BIGINT) % 6 END AS size FROM events), c AS (SELECT user_id, size, count(size) n, min(event_id) f FROM r GROUP BY user_id, size)
SELECT user_id, coalesce(size, 16) AS size FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY size IS NULL, n DESC, f) = 1""")
def body_font_size(spark, d):
    rows = rel.read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 > 0, 8 + F.floor("value") % 6).alias("size"))
    return filters.body_size(rows, "user_id", "event_id", "size")


# Further encoders


_ATTENTION, _CTC = _encode_sql("attention"), _encode_sql("ctc")


@query(f"SELECT doc_id, line_no, piece, CASE WHEN len(string_split(ids, ',')) = 25 THEN ids END AS ids FROM ({_ATTENTION})")
def encode_rfl(spark, d):
    """As for attention, but only sequences of the full length stay."""
    ids = sequences.encode(F.lower("bit"), sequences.ENCODERS["attention"])
    return rel.bits(spark, d).select("doc_id", "line_no", "piece", F.array_join(F.when(F.size(ids) == 25, ids).cast("array<string>"), ",").alias("ids"))


@query(f"SELECT doc_id, line_no, piece, array_to_string(list_transform(range(37), lambda i: len(list_filter(string_split(ids, ','), lambda x: x = CAST(i AS VARCHAR)))), ',') AS counts FROM ({_CTC}) WHERE ids IS NOT NULL")
def ctc_histogram(spark, d):
    """How often each number stands in the padded sequence, fills included."""
    # Null sequences go by explode: a filter would be pushed down with a second encoding.
    encoded = F.array_compact(F.array(sequences.encode(F.lower("bit"), sequences.ENCODERS["ctc"])))
    ids = rel.bits(spark, d).select("doc_id", "line_no", "piece", F.explode(encoded).alias("ids"))
    return ids.select("doc_id", "line_no", "piece", F.array_join(sequences.histogram(F.col("ids"), 37).cast("array<string>"), ",").alias("counts"))


@query(with_sql("pairs") + """, m AS (SELECT unnest(['clean', 'misread']) AS model, target, found FROM pairs), p AS (SELECT model, lower(regexp_replace(target, '[^0-9A-Za-z]', '', 'g')) a, lower(regexp_replace(CASE WHEN model = 'clean' THEN target ELSE found END, '[^0-9A-Za-z]', '', 'g')) b FROM m)
SELECT model, count(*) n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) matches, round(sum(CASE WHEN a = b THEN 1 ELSE 0 END) / (count(*) + 1e-5), 6) acc,
round(1 - sum(CASE WHEN greatest(length(a), length(b)) > 0 THEN levenshtein(a, b) / greatest(length(a), length(b)) ELSE 0.0 END) / (count(*) + 1e-5), 6) norm_edit_dis FROM p GROUP BY model""")
def multi_model(spark, d):
    """One metric for each model's results."""
    rows = rel.pairs(spark, d).withColumn("model", F.explode(F.array(F.lit("clean"), F.lit("misread"))))
    return metrics.recognition(rows.withColumn("found", F.when(F.col("model") == "clean", F.col("target")).otherwise(F.col("found"))), ["model"], "target", "found")
