"""Folders of files as a data source: read in parts, written with commit and abort, rewritten without the driver."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilframe.api import Anonymizer, anonymize_folder
from veilframe.sources import files, folder
from veilframe.sources import dictionary as K


def _left(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_round_trip(spark, tmp_path):
    texts = {"b/x.md": "# Æble\r\n\n", "a.txt": "", "b/c/y.tex": "\\textbf{x y} z", "a b.bib": "@article{k, title={T by John Doe}, author={John Doe}}"} | {f"n/{k:03}.txt": f"{k} " * k for k in range(60)}
    out = tmp_path / "out"
    folder.write_folder(spark.createDataFrame(list(texts.items()), "name string, text string").repartition(5), str(out))
    assert _left(out) == sorted(texts)  # nothing of the job is left
    assert {str(p.relative_to(out)): p.read_bytes().decode() for p in out.rglob("*") if p.is_file()} == texts
    got = spark.read.format("text_folder").option("bytes", 900).load(str(out))
    rows = got.orderBy("doc_id").collect()
    assert got.rdd.getNumPartitions() > 3 and [r.doc_id for r in rows] == list(range(len(texts)))
    assert [(r.path.removeprefix(f"{out}/"), r.text) for r in rows] == sorted(texts.items()) and {r.fmt for r in rows} == {"md", "txt", "tex", "bib"}
    prose = {r.path.removeprefix(f"{out}/"): r.text for r in files.prose(folder.read_folder(spark, f"file://{out}")).collect()}
    assert prose["b/c/y.tex"] == "y} z" and prose["a b.bib"] == "T by John Doe John Doe article k"


def test_nothing_is_left_of_a_job_that_fails(spark, tmp_path):
    out = tmp_path / "out"
    frame = lambda rows: spark.createDataFrame(rows, "name string, text string")
    with pytest.raises(PySparkException):
        folder.write_folder(frame([("a.txt", "x"), ("a.txt", "y")]), str(out))
    with pytest.raises(PySparkException):
        folder.write_folder(frame([("a.txt", "x")]).union(frame([("b.txt", "x")]).withColumn("text", F.raise_error(F.lit("no")))), str(out))
    for name in ("../a.txt", "/a.txt", "a.pdf"):
        with pytest.raises(PySparkException):
            folder.write_folder(frame([(name, "x")]), str(out))
    assert not out.exists() or _left(out) == []
    folder.write_folder(frame([]), str(out))
    assert folder.read_folder(spark, str(out)).count() == 0
    (out / "a.pdf").write_text("x")
    with pytest.raises(PySparkException, match="Unsupported file type: .pdf"):
        folder.read_folder(spark, str(out)).count()


def test_folders_are_rewritten(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    texts = {"a.md": "John Doe and 1234", "d/b.bib": "@article{k, title={By John Doe}, author={John Doe}}", "d/empty.bib": "", "e.txt": "", "in/c.txt": "none"}
    folder.write_folder(spark.createDataFrame(list(texts.items()), "name string, text string"), str(source))
    a = Anonymizer("en", spark)
    a.load_replacements(K.from_yaml('PERSON: [{id: "<PERSON_1>", variants: ["John Doe"]}]\nGENERAL_NUMBER: [{id: "<N>", variants: ["1234"]}]').plain())
    counts = anonymize_folder(str(source), a, str(out))
    got = {n: (out / n).read_text() for n in _left(out)}
    assert sorted(got) == sorted(texts) and got["a.md"] == "<PERSON_1> and <N>" and got["in/c.txt"] == "none" and got["e.txt"] == got["d/empty.bib"] == ""
    assert got["d/b.bib"].count("<PERSON_1>") == 2 and counts["person_replaced"] == 3 and counts["general_number_found"] == 1
