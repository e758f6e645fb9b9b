"""Files of audit documents: compressed, and none so large that one task has to read most of them."""

import os

from merchframe.operators import audit
from merchframe.sources import sinks


def _files(folder):
    return [os.path.join(at, f) for at, _, names in os.walk(folder) for f in names if f.startswith("part-")]


def _documents(spark, n):
    texts = [text for check in audit.CHECKS for text in check if isinstance(text, str)]
    rows = [(f"https://www.store{i}.com", "2024-05-06T07:08:09", (i, texts)) for i in range(n)]
    return spark.createDataFrame(rows, "store_url string, audit_date string, document struct<no: int, texts: array<string>>")


def test_audit_files_take_a_tenth_of_their_text(spark, tmp_path):
    documents = _documents(spark, 300).coalesce(1)
    sinks.write_audit_json(documents, str(tmp_path / "out"))
    documents.write.option("compression", "none").json(str(tmp_path / "plain"))
    assert 10 * sum(map(os.path.getsize, _files(tmp_path / "out"))) < sum(map(os.path.getsize, _files(tmp_path / "plain")))
    found = spark.read.json(str(tmp_path / "out")).collect()
    assert {(r.no, r.audit) for r in found} == {(i, f"store{i}.com_2024-05-06") for i in range(300)}
    assert len(found) == 300 and {len(r.texts) for r in found} == {len(documents.first().document.texts)}


def test_one_task_closes_a_file_after_so_many_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "DOCUMENTS_PER_FILE", 40)
    sinks.write_audit_json(_documents(spark, 100).coalesce(1), str(tmp_path / "out"))
    assert len(_files(tmp_path / "out")) == 3
    assert spark.read.json(str(tmp_path / "out")).count() == 100
