import io
import random
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import sequences, text
from quire.operators import documents
from quire.plans import registry
from quire.sources import labels, office


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit_box(*v):
    return tuple(F.lit(x) for x in v)


def test_overlap_ratio(spark):
    ratio = lambda a, b, mode: one(spark, g.overlap_ratio(lit_box(*a), lit_box(*b), mode))
    assert ratio([0, 0, 100, 100], [50, 50, 150, 150], "union") == pytest.approx(2500 / 17500)
    assert ratio([0, 0, 10, 10], [20, 20, 30, 30], "union") == 0
    assert ratio([0, 0, 100, 100], [0, 0, 200, 200], "small") == 1 and ratio([0, 0, 100, 100], [0, 0, 200, 200], "large") == 0.25
    assert ratio([0, 0, 0, 0], [0, 0, 0, 0], "union") == 0
    assert ratio([0, 0, 60000, 60000], [0, 0, 120000, 120000], "large") == 0.25
    with pytest.raises(ValueError):
        g.overlap_ratio(lit_box(0, 0, 1, 1), lit_box(0, 0, 1, 1), "invalid")


def test_boxes_and_polygons(spark):
    assert one(spark, g.enclosing(F.array(F.array(*map(F.lit, (10, 20, 30, 40))), F.array(*map(F.lit, (5, 15, 35, 45)))))) == [5, 15, 35, 45]
    assert one(spark, g.enclosing(F.from_json(F.lit("[]"), "array<array<int>>"))) == [0, 0, 0, 0]
    corners = F.from_json(F.lit("[[10,10],[0,0],[0,10],[10,0]]"), "array<array<double>>")
    assert one(spark, g.clockwise(corners)) == [[0, 0], [10, 0], [10, 10], [0, 10]]
    square, shifted = [(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    assert g.polygon_iou(square, shifted) == pytest.approx(1 / 7) and g.polygon_iou(square, square[::-1]) == pytest.approx(1)
    assert g.polygon_iou(square, [(5, 5), (6, 5), (6, 6)]) == 0


def test_text(spark):
    assert one(spark, text.half_width(F.lit("ＡＢ１　～x"))) == "AB1 ~x"
    assert one(spark, text.escape_markdown(F.lit("a*b`c~d$e"))) == r"a\*b\`c\~d\$e"
    assert one(spark, text.squash_lines(F.lit(" a \n\n  b\tc  d "))) == "a b\tc d"
    assert one(spark, text.squeeze_spaces(F.lit("a b   c"))) == "ab c"
    assert one(spark, text.strip_styles(F.lit("<b>x</b><sup>2</sup>"))) == "x2"
    assert one(spark, text.script_spaces(F.lit("abcسلامdef"))) == "abc سلام def"
    assert one(spark, text.is_rtl(F.lit("سلام ab"))) and one(spark, text.is_rtl(F.lit(""))) and not one(spark, text.is_rtl(F.lit("abc س")))
    assert one(spark, text.visual_order(F.lit("ab سل"))) == "لسab "
    assert [text.camel(n) for n in ("visualize", "top_p", "use_e2e_wired_table_rec_model", "")] == ["visualize", "topP", "useE2eWiredTableRecModel", ""]
    assert text.edit_distance("kitten", "sitting") == 3 and text.edit_distance([], ["a"]) == 1


def test_sequences(spark):
    found, score = sequences.decode(F.array(*map(F.lit, (1, 1, 0, 1))), F.array(*map(F.lit, (0.5, 0.9, 0.1, 0.7))), sequences.Decoder(skip=(0,), repeats=True, empty=0.0), ["blank", "a"])
    assert one(spark, found) == "aa" and one(spark, score) == pytest.approx(0.6)
    found, score = sequences.decode(F.array(F.lit(0)), F.array(F.lit(0.5)), sequences.Decoder(skip=(0,), empty=0.0), ["blank", "a"])
    assert one(spark, found) == "" and one(spark, score) == 0
    ids = sequences.encode(F.lit("a?b"), sequences.ENCODERS["ctc"], 4, "ab")
    assert one(spark, ids) == [1, 2, 0, 0] and one(spark, sequences.histogram(ids, 3)) == [2, 1, 1]
    assert one(spark, sequences.encode(F.lit("ab?xy"), sequences.ENCODERS["ctc"], 4, "ab")) is None
    assert one(spark, sequences.encode(F.lit(""), sequences.ENCODERS["ctc"], 4, "ab")) is None
    assert one(spark, sequences.encode(F.lit("a?b"), sequences.ENCODERS["pren"], 8, "ab")) == [3, 2, 4, 1, 0, 0, 0, 0]
    assert one(spark, sequences.encode(F.lit("abababababab"), sequences.ENCODERS["satrn"], 4, "ab")) == [3, 0, 1, 0]


def test_documents():
    assert documents.word_groups("Grüßen") == [("Grüßen", "en&num")] and documents.word_groups("ungewöhnlichen") == [("ungewöhnlichen", "en&num")]
    assert documents.word_groups("it's 3.14, 中文 a-b") == [("it's", "en&num"), ("3.14", "en&num"), ("中文", "cn"), ("a-b", "en&num")]
    assert documents.table_grid(["<tr>", "<td", ' colspan="2"', ">", "</td>", "<td></td>"], 9) == [(0, 0, 1, 2), (0, 2, 1, 1)]
    assert documents.table_grid(["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>"], 9) == [(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)]
    assert documents.table_grid(["<tr>", "<td></td>", "<td></td>"], 1) == [(0, 0, 1, 1)]
    assert documents.table_html(["<tr>", "<td></td>", "<td>", "</td>", "</tr>"], [["a"], ["<b>", "</b>"]]) == "<tr><td>a</td><td></td></tr>"
    wrap = lambda rows: f"<html><body><table>{rows}</table></body></html>"
    two = wrap("<tr><td>a</td><td>b</td></tr>")
    assert documents.table_similarity(two, two) == 1 and documents.table_similarity("", two) == 0
    assert documents.table_similarity(wrap("<tr><td>a</td></tr>"), two) == pytest.approx(1 - 1 / 3)
    assert documents.table_similarity(wrap('<tr><td colspan="2">a</td><td>b</td></tr>'), two) == pytest.approx(1 - 1 / 3)
    assert documents.fill_cells(2, [(0, "a"), (0, "<b")]) == ["a &lt;b", ""]


def test_label_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text('img/1.jpg\thello\n["x.jpg","y.jpg"]\tw\t320\t48\n')
    rows = labels.label_lines(spark, str(tmp_path / "a.txt"), sizes=True).collect()
    assert [(r["path"], r["label"], r["w"]) for r in rows] == [("img/1.jpg", "hello", None), ('["x.jpg","y.jpg"]', "w", 320.0)]
    assert one(spark, labels.one_path(F.lit('["x","y"]'), F.lit(1))) in ("x", "y") and one(spark, labels.one_path(F.lit("z"), F.lit(1))) == "z"
    df = spark.createDataFrame([('[{"transcription":"###","points":[[0,0],[9,0],[9,5],[0,5]]}]',), ("[]",), ("broken",)], "label string")
    found = labels.detection_labels(df).collect()
    assert len(found) == 1 and found[0]["boxes"][0]["ignored"]
    (tmp_path / "t.jsonl").write_text('{"filename":"f","html":{"cells":[{"tokens":["1"],"bbox":[1,2,3,4]},{"tokens":[]}],"structure":{"tokens":["<td>"]}}}\n{"filename":"g","html":{"structure":{"tokens":[]}}}\n')
    assert [r["filename"] for r in labels.table_labels(spark, str(tmp_path / "t.jsonl")).collect()] == ["f"]
    (tmp_path / "p.PNG").write_bytes(b"\x89PNG")
    assert [r["kind"] for r in labels.image_files(spark, str(tmp_path)).collect()] == ["png"]


def test_results_and_inputs(spark):
    line = '{"result":{"dataInfo":{"numPages":"1"},"ocrResults":[{"prunedResult":{"rec_texts":["hello"," "],"rec_scores":[0.5,1.0]},"ocrImage":"ocr.png"}]}}'
    pages = labels.pages_of(spark.createDataFrame([(1, line), (2, " "), (3, "{bad")], "id int, value string")).orderBy("id").collect()
    assert [(r["id"], r["valid"]) for r in pages] == [(1, True), (3, False)]
    summary = labels.page_summary(labels.pages_of(spark.createDataFrame([(1, line)], "id int, value string")), ["id"]).first()
    assert (summary["text"], summary["confidence"], summary["n_lines"]) == ("hello", 0.5, 1)
    for value, wrong in (('{"code":0,"data":{"jobId":"a","state":"running"}}', None), ('{"code":0,"data":{"jobId":"a","state":"done"}}', "no resultUrl"), ('{"code":5,"data":{}}', "code 5"), ("x", "not json"), ('{"data":{"jobId":"a","state":"odd"}}', "unknown state")):
        assert one(spark, labels.envelope(F.lit(value))) == wrong
    for value, kind in (("https://x/y", "url"), ("data:image/png;base64,AA==", "data-url"), ("aGVsbG8gd29ybGQhISEh", "base64"), ("/a/b", "path"), ("a/b", "relative")):
        assert one(spark, labels.input_kind(F.lit(value))) == kind
    assert one(spark, labels.magic(F.lit(bytearray(b"%PDF-1.7")))) == "pdf" and one(spark, labels.magic(F.lit(bytearray(b"zz")))) is None
    entities = spark.createDataFrame([(1, 0, "question", "q", [[0, 1]]), (1, 1, "answer", "a", [[1, 0]]), (1, 2, "answer", " ", [[0, 2]])], "doc int, id int, label string, text string, linking array<array<int>>")
    assert [tuple(r) for r in labels.form_links(entities, "doc").collect()] == [(1, 0, 1)]


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def test_office(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r></w:p>' + "".join(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{c}</w:t></w:r></w:p>' for c in "ab") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    assert office.docx(packed({"word/document.xml": doc})) == "# T\n\n**x**\n\n1. a\n\n2. b\n\n<table><tr><th>h</th></tr></table>"
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = packed({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {s}><si><t>k</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="B2" t="s"><v>0</v></c></row><row><c r="C3"><v>5</v></c></row></sheetData></worksheet>'})
    assert office.xlsx(book) == "## S\n\n<table><tr><th>k</th><th></th></tr><tr><td></td><td>5</td></tr></table>"
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    deck = packed({f"ppt/slides/slide{i}.xml": f"<x {a}><a:p><a:r><a:t>s{i}</a:t></a:r></a:p></x>" for i in (2, 10)})
    assert office.pptx(deck) == "s2\n\n---\n\ns10"
    rows = spark.createDataFrame([("a.xlsx", bytearray(book)), ("b.zzz", bytearray(b"")), ("c.docx", bytearray(b"no zip")), ("d.docx", bytearray(packed({"word/document.xml": "<!DOCTYPE x [<!ENTITY e 'x'>]><x/>"})))], "path string, content binary")
    found = {r["path"]: r for r in office.converted(rows).collect()}
    assert found["a.xlsx"]["error"] is None and all(found[p]["markdown"] is None and found[p]["error"] for p in ("b.zzz", "c.docx", "d.docx"))


def test_registry(spark):
    class Stub:
        def predict(self, frame):
            return pd.DataFrame({"n": frame["text"].str.len()})

    kept = registry.Registry("thing")
    kept.register("a", 1)
    with pytest.raises(ValueError):
        kept.register("a", 2)
    with pytest.raises(KeyError):
        kept.get("b")
    assert registry.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a.b": 5, "d": None, "e.f": 6}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": {"f": 6}}
    if "longer" not in registry.OPS.known:
        registry.OPS.register("longer", lambda df, least: df.filter(F.length("text") >= least))
    df = spark.createDataFrame([("ab",), ("abcd",)], "text string")
    assert registry.chain(df, [("longer", {"least": 3})]).count() == 1
    assert sorted(r["n"] for r in registry.predict(df, Stub, "n long").collect()) == [2, 4]


@pytest.mark.parametrize("name", sorted(sequences.ENCODERS))
def test_encoders_look_characters_up_once(name):
    assert str(sequences.encode(F.col("t"), sequences.ENCODERS[name])).count("split(") == 1


def test_histogram_of_nulls_and_strangers(spark):
    rows = spark.createDataFrame([(0, [1, None, 9, -1, 1]), (1, None), (2, []), (3, [2])], "i int, s array<int>").coalesce(1)
    assert [r["v"] for r in rows.orderBy("i").select(sequences.histogram(F.col("s"), 3).alias("v")).collect()] == [[0, 2, 0], None, [0, 0, 0], [0, 0, 1]]


def test_tables_of_one_shape_together(monkeypatch):
    """Together as alone, with spans, styles, long cells and nested ends; and 600 tables of 29 nodes in a fraction of the seconds that one after another take."""
    rng = random.Random(0)
    cell = lambda: rng.choice(["<td>", "<td>", '<td colspan="2">']) + rng.choice(["", "a", "ab", "<b>x</b>", "&lt;", "1234", "1324", "y" * 40]) + "</td>"
    page = lambda n: "<html><body><table>" + "".join("<tr>" + "".join(cell() for _ in range(2)) + "</tr>" for _ in range(n)) + "</table></body></html>"
    found, truth = ([page(rng.randint(1, 3)) for _ in range(300)] for _ in range(2))
    together = documents.table_similarities([*found, None], [*truth, truth[0]])
    monkeypatch.setattr(documents, "TOGETHER", 1 << 30)
    assert together == [*(documents.table_similarity(a, b) for a, b in zip(found, truth)), 0.0]
    monkeypatch.undo()
    plain = lambda: "<html><body><table>" + "".join(f"<tr><td>{rng.randrange(20000)}</td><td>R</td><td>F</td></tr>" for _ in range(7)) + "</table></body></html>"
    assert documents.table_tree(plain())[2][6][2][1] == ["td", "1,1|R", []]
    began = time.process_time()
    documents.table_similarities(*[[plain() for _ in range(600)] for _ in range(2)])
    assert time.process_time() - began < 3  # one after another: 9 s


def test_jobs(spark, sf, tmp_path):
    from quire.streaming import jobs

    assert jobs.poll_times()[:4] == [3.0, 7.5, 14.25, 24.375] and max(jobs.poll_times()) <= 600
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = jobs.track_jobs(jobs.job_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
    query = stream.writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    rows, until = spark.read.parquet(f"{sf}/events.parquet").count(), time.time() + 120
    # With processing-time timeouts, empty batches follow one another, so there is no last one to wait for.
    while sum(p["numInputRows"] for p in query.recentProgress) < rows and time.time() < until:
        time.sleep(0.5)
    query.stop()
    found = {tuple(r) for r in spark.table("tracked").select("job_id", "state", "n", "changes").collect()}
    assert found == {tuple(r) for r in jobs.job_states(spark.read.parquet(f"{sf}/events.parquet")).select("job_id", "state", "n", "changes").collect()}
