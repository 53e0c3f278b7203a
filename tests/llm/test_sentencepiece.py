from __future__ import annotations

from array import array

import pytest

from tessera.llm import sentencepiece_codec as C

TEXTS = [None, "", " ", "a", "  two  spaces ", "a\nb\n\n c", "日本 語é\t\r\nx", "▁literal ▁", " " * 40 + "z", "ab" * 400, "😀", "Hello world. This is a text of some words, and 12345 numbers!"]


@pytest.fixture(scope="module")
def vocab(spark):
    return C.load_pieces(spark)


def whole_viterbi(vocab, encoder, text):
    text = " " + text
    best = [(0.0, ())] + [None] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j - 1, max(0, j - encoder.longest) - 1, -1):
            piece = vocab["pieces"].get(text[i:j])
            ids = (piece[0],) if piece else tuple(vocab["bytes"][b] for b in text[i].encode()) if j == i + 1 else None
            if best[i] and ids:
                score = best[i][0] + (piece[1] if piece else encoder.unknown)
                if best[j] is None or score > best[j][0]:
                    best[j] = score, best[i][1] + ids
    return best[-1][1]


def test_streaming_equals_whole_search(vocab):
    encoder = C.Encoder(vocab)
    for text in filter(None, TEXTS):
        out = array("i")
        encoder.encode(text, out)
        assert tuple(out) == encoder.search(" " + text) == whole_viterbi(vocab, encoder, text)


def test_short_chunks_equal_the_streaming_search(vocab):
    """Words go by lists of all their boundaries; ties, bytes and characters that no piece holds fall as in the search."""
    import pyarrow.parquet as pq

    encoder = C.Encoder(vocab)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60]] + [t or "" for t in TEXTS]
    chunks = {" " + w for t in texts for w in t.split(" ")} | {"", "é▁é", "😀😀", "\ud800x"}
    before = encoder.commits
    assert all(encoder.whole(c) == array("i", encoder.found(c)).tolist() for c in chunks if len(c) <= C.LONG) and encoder.commits == before
    assert all(encoder.whole(c) == list(encoder.search(c)) for c in chunks)
    assert any(len(c) > 2 and c[-2:] not in encoder.pairs for c in chunks)


def test_ids_are_committed_on_ordinary_texts(vocab):
    """All paths meet within words too, so most ids are final long before a text ends."""
    import pyarrow.parquet as pq

    encoder, chunks = C.Encoder(vocab), 0
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60]:
        ids = encoder.search(" " + (text or ""))
        chunks += len((text or "").split())
        out = array("i")
        encoder.encode(text or "", out)
        assert tuple(out) == ids or not text
    assert encoder.commits > chunks and encoder.widest <= 4 * encoder.longest


@pytest.mark.parametrize("unit", ["a", "ab", "the quick brown fox, ", "日本", "xyzzy-", "  a"])
def test_a_long_text_holds_a_small_window(vocab, unit):
    encoder, text = C.Encoder(vocab), unit * (200_000 // len(unit))
    ids = encoder.search(" " + text)
    assert b"".join(vocab["raw"][k] for k in ids).decode() == " " + text
    assert encoder.commits > 1000 and encoder.widest <= 8 * encoder.longest
    out = array("i")
    encoder.encode(text, out)
    assert tuple(out) == ids


def test_windows_end_between_pieces(vocab, monkeypatch):
    encoder = C.Encoder(vocab)
    for width in (1, 2, 7):
        monkeypatch.setattr(C, "WINDOW", width)
        for text in filter(None, TEXTS):
            out = array("i")
            encoder.encode(text, out)
            assert tuple(out) == encoder.search(" " + text)


def test_exact_round_trip(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    back = C.decode_documents(C.encode_documents(docs))
    assert [r["text"] for r in back.orderBy("doc_id").collect()] == TEXTS
    odd = C.decode_documents(C.encode_documents(odd_docs)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in odd) == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd_docs.collect())
    assert C.encode_documents(no_docs).count() == 0
