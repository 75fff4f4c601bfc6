"""Sources, sinks and resumable writes."""

import json

import pytest
from pyspark.sql import functions as F

from strandlake.sources import documents as doc
from strandlake.sources import sinks
from strandlake.sources import tabular as tab
from strandlake.streaming.resumable import ManifestMismatch, process_available, resumable_write, windowed_counts


def test_text_tables(spark, tmp_path):
    (tmp_path / "s.txt").write_text("junk\nmore junk\n#VariationID\tDescription\n1\tx\n2\t\n")
    got = tab.read_after_banner(spark, str(tmp_path / "s.txt"), 2).collect()
    assert [(r.VariationID, r.Description) for r in got] == [("1", "x"), ("2", "")]
    (tmp_path / "g.gff").write_text("##gff-version 3\nchr1\tsrc\tgene\t5\t9\t.\t+\t.\tID=gene-A\n")
    g = tab.read_gff(spark, str(tmp_path / "g.gff")).first()
    assert (g.Feature, g.Start, g.End, g.Attributes) == ("gene", 5, 9, "ID=gene-A")
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows = tab.read_json_lines(spark, str(tmp_path / "j.jsonl"), "a long").collect()
    assert [r.doc.a if r.doc else None for r in rows] == [1, None, 2]
    (tmp_path / "m.csv").write_text("case_id,ref\n a1 ,c\nb,\n")
    assert [tuple(r) for r in tab.read_manifest(spark, str(tmp_path / "m.csv"), ["case_id", "ref", "alt"]).collect()] == [("a1", "C", ""), ("b", "", "")]
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    for _ in range(2):
        assert tab.read_through(spark, str(tmp_path / "c.csv"), str(tmp_path / "c.parquet"), "a long, b string").collect() == [(1, "x")]


def test_aliases_and_cleaning(spark):
    df = spark.createDataFrame([("1", "A", None), ("0", "C", "T")], "` Position` string, REF string, alt string")
    out = tab.resolve_aliases(df, {"pos": ["pos", "position"], "ref": ["ref"], "alt": ["alt"], "gene": ["gene"]})
    assert out.columns == ["pos", "ref", "alt", "gene"] and out.first().gene is None
    assert tab.clean_variants(out.withColumn("pos", F.col("pos").cast("long"))).count() == 0


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">chr1 first\nACGTAC\nGTAC\n>2\nNNNNNN\n")
    contigs = doc.read_fasta(spark, str(tmp_path / "x.fa"), chunk=4)
    assert sorted((r.chrom, r.chunk_idx, r.seq) for r in contigs.collect()) == [("2", 0, "NNNN"), ("2", 1, "NN"), ("chr1", 0, "ACGT"), ("chr1", 1, "ACGT"), ("chr1", 2, "AC")]
    spans = spark.createDataFrame([("1", 2, 9), ("chr1", 0, 10), ("chr1", 8, 12), ("chr2", 0, 3), ("chr9", 0, 1), ("chr1", 4, 8)], "chrom string, start long, end long")
    got = {(r.chrom, r.start, r.end): r.letters for r in doc.fetch_spans(spans, contigs, chunk=4).collect()}
    assert got == {("1", 2, 9): "GTACGTA", ("chr1", 0, 10): "ACGTACGTAC", ("chr1", 8, 12): None, ("chr2", 0, 3): None, ("chr9", 0, 1): None, ("chr1", 4, 8): "ACGT"}


def test_alignment(spark, tmp_path):
    (tmp_path / "a.aln").write_text("CLUSTAL W\n\nh1   ACG-\nh2   ACTT\n      **\n\nh1   AA\nh2   AC\n")
    a = doc.read_alignment(spark, str(tmp_path / "a.aln"))
    assert {r.name: r.sequence for r in a.collect()} == {"h1": "ACG-AA", "h2": "ACTTAC"}
    share = {r.column: (r.letter, r.share) for r in doc.alignment_identity(a).collect()}
    assert share[0] == ("A", 1.0) and share[2] == ("G", 0.5)


def test_markup(spark):
    html = "<table><tr><th>x</th></tr></table><table><tr><th>Gene</th><th>Pos</th></tr><tr><td>A &amp; B<script>no()</script></td><td> 1\n2 </td></tr></table>"
    rows = doc.html_tables(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), "page_id", "html")
    got = doc.table_with_header(rows, "page_id", ["gene", "phenotype"]).collect()
    assert [(r.page_id, r.header, r.cells) for r in got] == [(1, ["Gene", "Pos"], ["A & B", "1 2"])]
    svg = spark.createDataFrame([(1, '<svg><rect x="1" fill="red"/><rect y="2"/></svg>')], "i long, s string")
    assert [(r.position, r.x, r.y) for r in doc.svg_elements(svg, "i", "s", "rect", ["x", "y"]).collect()] == [(0, "1", None), (1, None, "2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello", ["b", "a"], {"k": 1.0})], "i int, p string, l array<string>, m map<string,double>")
    sinks.write_request_lines(df, str(tmp_path / "r"), "i", "p", "m1")
    line = json.loads(spark.read.text(str(tmp_path / "r")).first().value)
    assert line["custom_id"] == "1" and line["params"]["messages"][0]["content"] == "hello"
    sinks.write_csv_cells(df, str(tmp_path / "c"))
    assert tuple(spark.read.csv(str(tmp_path / "c"), header=True).first()) == ("1", "hello", "a;b", '{"k":1.0}')
    assert sinks.input_fingerprint(spark.range(9), ["id"]) == sinks.input_fingerprint(spark.range(9).repartition(4), ["id"]) != sinks.input_fingerprint(spark.range(8), ["id"])


def test_resume_runs_nothing_and_refuses_other_settings(spark, tmp_path):
    df, seen = spark.range(100), []

    def slow(part):
        seen.append(1)
        return part.withColumn("x", F.col("id") * 2)

    folder = f"file://{tmp_path}/out"
    assert resumable_write(df, folder, "id", 4, {"model": "a"}, slow) == 4
    assert resumable_write(df, folder, "id", 4, {"model": "a"}, slow) == 0 and len(seen) == 4
    assert spark.read.parquet(folder + "/part=*").count() == 100
    with pytest.raises(ManifestMismatch):
        resumable_write(df, folder, "id", 4, {"model": "b"}, slow)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, sink, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    events.repartition(3).write.parquet(source)
    double = lambda d: d.withColumn("twice", F.col("value") * 2)
    assert process_available(spark, source, events.schema, sink, state, double, 1) == 3
    assert process_available(spark, source, events.schema, sink, state, double, 1) == 0
    assert spark.read.parquet(sink + "/batch=*").exceptAll(double(events)).count() == 0
    assert windowed_counts(events, "ts", "event_type").agg(F.sum("n")).first()[0] == events.count()
