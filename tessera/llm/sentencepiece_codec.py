"""SentencePiece encoding and decoding by a streaming Viterbi search over the pieces' scores."""

from __future__ import annotations

import re
from array import array
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, slices

#: Where the public vocabulary is; always a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks remembered by a worker (twice as many at most, none longer than LONG), some 200 bytes each; only speed depends on it.
REMEMBERED, LONG = 250_000, 64
#: Characters of a text that are parted into chunks at once, and where a window may end.
WINDOW, RUN_OF_SPACES = 1 << 16, re.compile(r"(?<! ) ")


def load_pieces(spark: SparkSession, path: str = MODEL) -> dict:
    """The vocabulary as plain tables, read by Spark so that the path may be in any store. Its size is fixed (32,000 pieces)."""
    import sentencepiece

    data = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").first()["content"]
    sp = sentencepiece.SentencePieceProcessor(model_proto=bytes(data))
    pieces, raw, bytes_ = {}, [], [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            raw.append(bytes([int(piece[3:5], 16)]))
            bytes_[int(piece[3:5], 16)] = i
        elif sp.is_control(i) or sp.is_unknown(i):
            raw.append(b"")
        else:
            piece = piece.replace("▁", " ")
            raw.append(piece.encode())
            pieces[piece] = (i, sp.get_score(i))
    return {"pieces": pieces, "raw": raw, "bytes": bytes_}


class Encoder:
    """Ids of texts. A space opens every text and stands for the space mark; a literal U+2581 is no piece and goes by its bytes."""

    def __init__(self, vocab: dict) -> None:
        self.trie: dict = {}  # character: [what may follow, id, score]; the id is None where no piece ends
        for piece, entry in vocab["pieces"].items():
            follow, node = self.trie, [None, None, 0.0]
            for c in piece:
                node = follow.setdefault(c, [{}, None, 0.0])
                follow = node[0]
            node[1:] = entry
        self.bytes, self.longest = vocab["bytes"], max(map(len, vocab["pieces"]), default=1)
        self.unknown = min((s for _, s in vocab["pieces"].values()), default=0.0) - 10
        # Where no piece crosses, all paths converge: before a run of spaces, and around a character that no piece holds.
        self.by_space = not any(" " in p.lstrip(" ") for p in vocab["pieces"])
        self.by_line = not any("\n" in p for p in vocab["pieces"])
        self.commits = self.widest = 0  # how often ids were committed before a chunk's end, and the most backpointers held
        self.pairs = {p[k : k + 2] for p in vocab["pieces"] for k in range(len(p) - 1)}
        self.words, self.chunks = Remembered(lambda w: self.found(" " + w)), Remembered(self.found)

    def found(self, chunk: str) -> bytes:
        """A chunk's ids, as remembered: four bytes each. If no piece holds its last two characters, such as a letter and a full stop, it ends
        in two chunks, of which others end in the first one too."""
        if len(chunk) > LONG:
            return array("i", self.search(chunk)).tobytes()
        if len(chunk) > 2 and chunk[-2:] not in self.pairs:
            return (self.words[chunk[1:-1]] if chunk[0] == " " else self.chunks[chunk[:-1]]) + self.chunks[chunk[-1]]
        return array("i", self.whole(chunk)).tobytes()

    def whole(self, text: str) -> list[int]:
        """search() of a short text, whose scores and backpointers are all held, in lists, until its end."""
        n, first, unknown = len(text), self.trie, self.unknown
        best, back, ids = [-inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, j, follow = best[i], i, first
            for c in text[i:]:
                if c not in follow:
                    break
                follow, piece, score = follow[c]
                j += 1
                if piece is not None and (score := here + score) >= best[j]:
                    best[j], back[j], ids[j] = score, i, piece
            if (j == i or first[text[i]][1] is None) and (score := here + unknown) >= best[i + 1]:
                best[i + 1], back[i + 1], ids[i + 1] = score, i, -1
        out: list[int] = []
        while n:
            i, piece = back[n], ids[n]
            if piece >= 0:
                out.append(piece)
            else:
                out += (self.bytes[b] for b in reversed(text[i].encode("utf-8", "replace")))
            n = i
        return out[::-1]

    def search(self, text: str) -> tuple[int, ...]:
        """The ids of the best path. Of equal scores at a boundary the path whose last piece is shortest stays: then paths meet soon.

        Scores are kept for the boundaries ahead only, as many as the longest piece has characters, and backpointers from the last
        commit on. Where no piece crosses a boundary, or when the backpointers of all reachable boundaries ahead meet in one, the
        ids up to it are final and are committed.
        """
        out: list[int] = []
        best, back, base, far, n, longest = {0: 0.0}, {}, 0, 0, len(text), self.longest
        check, commits, widest = longest, 0, self.widest
        for i in range(n):
            if i == far:
                if i:
                    before, piece = back[i]
                    if before == base and piece >= 0:
                        out.append(piece)
                    else:
                        out += self.path(text, back, base, i)
                    if len(back) > widest:
                        widest = len(back)
                    back.clear()
                    base, check, commits = i, longest, commits + 1
            elif i - base >= check:
                meet = self.meeting(best, back, base)
                widest = max(widest, len(back))
                if meet > base:
                    out += self.path(text, back, base, meet)
                    back = {j: b for j, b in back.items() if j > meet}
                    base, check, commits = meet, longest, commits + 1
                else:
                    check += max(longest, check // 2)
            here, follow, j, single = best.pop(i), self.trie, i, False
            while j < n and (node := follow.get(text[j])) is not None:
                follow, piece, score = node
                j += 1
                if piece is not None:
                    single |= j == i + 1
                    score += here
                    if j not in best or score >= best[j]:
                        best[j], back[j] = score, (i, piece)
                        if j > far:
                            far = j
            if not single:
                score = here + self.unknown
                if i + 1 not in best or score >= best[i + 1]:
                    best[i + 1], back[i + 1] = score, (i, -1)
                    far = max(far, i + 1)
        self.commits, self.widest = self.commits + commits, widest
        return (*out, *self.path(text, back, base, n))

    def meeting(self, best: dict, back: dict, base: int) -> int:
        """The last boundary that all paths to the boundaries ahead go through."""
        ahead = set(best)
        while len(ahead) > 1:
            last = max(ahead)
            if last <= base:
                break
            ahead.discard(last)
            ahead.add(back[last][0])
        return max(ahead)

    def path(self, text: str, back: dict, start: int, end: int) -> list[int]:
        ids: list[int] = []
        while end > start:
            i, piece = back[end]
            ids += [piece] if piece >= 0 else [self.bytes[b] for b in reversed(text[i].encode("utf-8", "replace"))]
            end = i
        return ids[::-1]

    def encode(self, text: str, out: array) -> None:
        """A text goes through in windows that end where no piece crosses, so that a long one is never held in parts. Within them the
        search starts anew at each such place, and what it found for a chunk before may be remembered."""
        if not self.by_space:
            out.extend(self.search(" " + text) if text else ())
            return
        at, n = 0, len(text)
        while at < n:
            cut = RUN_OF_SPACES.search(text, at + WINDOW) if n - at > WINDOW else None
            end = cut.start() if cut else n
            self.chunked(text[at:end] if at else " " + text[:end], out)
            at = end

    def chunked(self, text: str, out: array) -> None:
        for k, line in enumerate(text.split("\n") if self.by_line else [text]):
            if k:
                out.append(self.bytes[10])
            if "  " in line or line.endswith(" "):
                out.frombytes(b"".join(map(self.chunks.__getitem__, re.findall(r" *[^ ]+| +$", line))))
            elif line:
                first, *rest = line.split(" ")
                if first:
                    out.frombytes(self.chunks[first])
                out.frombytes(b"".join(map(self.words.__getitem__, rest)))


class Remembered(dict):
    """Results of f, the recent ones remembered; old ones go a generation at a time."""

    def __init__(self, f) -> None:
        super().__init__()
        self.f, self.old = f, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.f(key)
        if len(key) <= LONG:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def encode_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """keep and ids (array<int>) of each row's whole text. A null text has null ids, an empty one none. Rows stay as they are:
    repeated rows are encoded each, other columns are not read. Every text comes back exactly by decode_documents."""
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(load_pieces(spark, model))
    chosen = docs.select(*keep, "text")

    def run(batches):
        # A worker lives on from task to task, and with it the broadcast value: what was remembered serves the next task.
        encoder = vocab.value.get("encoder") or vocab.value.setdefault("encoder", Encoder(vocab.value))
        for batch in slices(batches):
            flat, ends = array("i"), array("q", [0])
            texts = batch.column(len(keep))
            for text in texts.to_pylist():
                encoder.encode(text or "", flat)
                ends.append(len(flat))
            ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
            if texts.null_count:
                ids = pa.compute.if_else(texts.is_null(), pa.scalar(None, ids.type), ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), ids], [*keep, "ids"])

    fields = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes if c != "text")
    return map_batches(chosen, run, f"{fields}, ids array<int>")


def decode_documents(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """keep and text of each row's ids. Null ids give a null text; ids that no piece has are an error."""
    spark = encoded.sparkSession
    vocab = spark.sparkContext.broadcast(load_pieces(spark, model))
    chosen = encoded.select(*keep, "ids")

    def run(batches):
        raw = vocab.value["raw"]
        for batch in slices(batches):
            ids = batch.column(len(keep))
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), [0, *pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0)).to_pylist()]
            texts = [b"".join(map(raw.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace")[1:] for a, b in zip(ends, ends[1:])]
            texts = pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False) if ids.null_count else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), texts], [*keep, "text"])

    fields = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes if c != "ids")
    return map_batches(chosen, run, f"{fields}, text string")
