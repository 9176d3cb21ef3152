"""Arrow frames are never turned into Python objects as a whole."""

import pyarrow as pa

from uttermark.functions import frames


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(frames, "PIECE_BYTES", 100)
    texts = pa.array(["a" * 30, None, "é" * 20, "b" * 500, "", None, "c"] * 9)
    for columns in ((texts,), (texts, pa.array(list(reversed(texts.to_pylist()))))):
        cut = list(frames.pieces(columns))
        assert len(cut) > 9
        for piece in cut:
            sizes = [sum(len((v or "").encode()) for v in row) for row in zip(*(c.to_pylist() for c in piece))]
            assert sum(sizes) < 200 or sum(sorted(sizes)[:-1]) < 200
        for i, column in enumerate(columns):
            assert pa.concat_arrays([piece[i] for piece in cut]).equals(column)


def test_rows_keep_their_places(monkeypatch):
    monkeypatch.setattr(frames, "PIECE_BYTES", 8)
    left, right = pa.array(["ab", None, "c", "", "long enough"]), pa.array(["x", "y", None, "", "z"])
    got = frames.row_by_row(lambda a, b: len(a + b), pa.int32(), left, right)
    assert got.to_pylist() == [3, None, None, 0, 12] and got.type == pa.int32()
    assert frames.row_by_row(len, pa.int32(), pa.array([], pa.string())).to_pylist() == []
    assert frames.row_by_row(str, pa.string(), left.slice(1, 3)).to_pylist() == [None, "c", ""]


def test_only_a_piece_is_in_python_at_once(monkeypatch):
    monkeypatch.setattr(frames, "PIECE_BYTES", 1000)
    held = []
    real = frames.pieces
    monkeypatch.setattr(frames, "pieces", lambda columns: (held.append(p[0].nbytes) or p for p in real(columns)))
    frames.row_by_row(len, pa.int32(), pa.array(["t" * 100] * 500))
    assert len(held) >= 45
