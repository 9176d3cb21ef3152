"""The rescoring queries keep a text once in their own tables, and remove what they have read."""

from pathlib import Path

import pytest

from uttermark.operators.staging import shared_folder
from uttermark.plans import catalogue
from uttermark.streaming import samples


@pytest.mark.parametrize("name", ["stream_rescoring", "stream_rescoring_samples"])
def test_files_are_compressed_and_removed(spark, tmp_path, monkeypatch, name):
    data = [(i, "en", "s0", 40, f"alpha beta gamma number {i} delta") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, lang string, source string, n_chars long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(shared_folder(spark).removeprefix("file://")) / "uttermark"
    before = set(folder.iterdir()) if folder.exists() else set()
    seen = []
    discard = catalogue.discard

    def noted(spark, path):
        seen.extend(f.suffix for f in Path(path.removeprefix("file://")).rglob("part-*"))
        discard(spark, path)

    monkeypatch.setattr(catalogue, "discard", noted)
    got = {(r.model, r.split): (r.samples, r.errors, r.wer) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(got) == 6 and all(samples == 20 for samples, _, _ in got.values())
    assert set(seen) == {".gz"}
    assert {p.name.split("-")[0] for p in set(folder.iterdir()) - before} == {"sums", "progress"}


def test_triggers_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    """A trigger took up to 1,000 files, however large, and shuffled all their texts at once (F4)."""
    path = str(tmp_path / "runs")
    for part in range(4):
        rows = spark.range(4).selectExpr("'sample' audio_filepath", "repeat('a ', 5000) text", "'' pred_text", "1L version", "'m' model", "'d' dataset", "'s' split")
        rows.coalesce(1).write.mode("append").partitionBy("model", "dataset", "split").json(path)
    monkeypatch.setattr(catalogue, "_TRIGGER_BYTES", (1, 10**9))
    monkeypatch.setattr(catalogue, "_TRIGGER_PARTS", 4)
    limit = catalogue._trigger_bytes(spark, path)
    assert 40_000 <= limit <= 42_000
    counts = []
    stream = samples.versioned_stream(spark, path, bytes_per_trigger=limit)
    writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, _: counts.append(batch.count())).start().awaitTermination()
    assert sum(counts) == 16 and len(counts) >= 3
