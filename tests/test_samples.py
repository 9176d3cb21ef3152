import pytest
from pyspark.sql import functions as F

from uttermark.operators.staging import new_path
from uttermark.sources import manifests
from uttermark.streaming import samples

SCHEMA = "audio_filepath string, duration double, time double, text string, pred_text string, version long, model string, dataset string, split string"


@pytest.fixture
def board(spark, rows):
    """Deliver rows, and read the scores."""
    path, sums, progress = (new_path(spark, n) for n in ("runs", "sums", "progress"))

    def deliver(data):
        rows([(f"s{i}", d, t, r, h, v, "m", "d", s) for i, d, t, r, h, v, s in data], SCHEMA).write.mode("append").option(
            "ignoreNullFields", "false"
        ).partitionBy(*manifests.RUN_KEYS).json(path)
        samples.start_sample_rescoring(samples.versioned_stream(spark, path), sums, progress, buckets=3).awaitTermination()
        got = samples.stored_sample_scores(spark, sums).collect()
        return {r.split: (r.samples, r.lost, r.errors, r.words, r.scored, r.rtfx) for r in got}

    return deliver


def test_versions_and_redelivery(board):
    first = [(i, 2.0, 1.0, " a b  c", "a b c" if i % 2 else "a x c", 1, "test") for i in range(10)]
    assert board(first) == {"test": (10, 0, 5, 30, 10, 2.0)}
    # The same rows once more, and one of them with other texts: what this version has told stays.
    assert board(first + [(0, 2.0, 1.0, "a", "b", 1, "test")]) == {"test": (10, 0, 5, 30, 10, 2.0)}
    # A rerun without the last two samples: three changed, one of them lost; the others are not scored again.
    again = [(i, 2.0, 1.0, "a b c", {0: "a b c", 1: "z z z", 2: None}.get(i, h), 2, "test") for i, _, _, _, h, _, _ in first[:8]]
    assert board(again) == {"test": (8, 1, 8, 24, 13, 2.0)}
    # Rows of the old version come late; another run arrives, untimed.
    late = [(9, 2.0, 1.0, "a b c", "q", 1, "test"), (0, 1.0, None, "", "two words", 1, "dev"), (1, 1.0, 0.5, None, None, 1, "dev")]
    assert board(late) == {"test": (8, 1, 8, 24, 13, 2.0), "dev": (2, 1, 2, 0, 2, None)}


def test_state_comes_back_after_a_restart_without_news(board):
    data = [(i, 1.0, 1.0, "a b", "a", 1, "test") for i in range(4)]
    assert board(data) == board([]) == {"test": (4, 0, 4, 8, 4, 1.0)}
