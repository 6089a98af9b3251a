"""SentencePiece BPE encoding and decoding by a table of last tokens.

For every prefix of a segment there is exactly one token that can end its encoding. An automaton lists the pieces that end at
each position; the piece whose pair with the last token before it is stable under merging is that token. Ids are then read off
backwards. Texts are cut only between characters that no piece holds side by side, so encodings of segments join to that of the
text; segments recur, so workers remember a bounded number of them.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import small_batches

MARK = "▁"
#: Segments a worker remembers at most, of at most LONGEST characters each.
REMEMBERED, LONGEST = 300_000, 64
_NO_LIMIT = 1 << 60


class Encoder:
    """Tables from a model file. Tokens are ordered as merges are: characters first, then pieces by score."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.path = path
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        assert model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and model.normalizer_spec.name == "identity"
        assert model.normalizer_spec.add_dummy_prefix and not model.normalizer_spec.remove_extra_whitespaces
        self.end = model.trainer_spec.eos_id
        self.surface = {i: p.piece for i, p in enumerate(model.pieces)}
        self.bytes = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == 3}
        pieces = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        pieces.sort(key=lambda x: (len(x[1]) > 1, -x[2], x[0]))
        self.ids = [i for i, _, _ in pieces]
        self.rank = {text: r for r, (_, text, _) in enumerate(pieces)}
        self.pairs = {(a, b) for text in self.rank for a, b in zip(text, text[1:], strict=False)}
        self.split: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        reachable = {}
        for text, r in self.rank.items():
            if len(text) == 1:
                reachable[text] = r
            elif parts := self._halves(text):
                self.split[r] = parts
                self.made[parts] = r
                reachable[text] = r
        self.matches = {text: (r, len(text)) for text, r in reachable.items()}
        self.by_word = all(b != MARK or a == MARK for a, b in self.pairs)
        self._forget()

    def _forget(self):
        self.automaton, self.stable, self.known = None, {}, {}

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "stable": {}, "known": {}}

    def _halves(self, text: str) -> tuple[int, int] | None:
        """The last two tokens that merge into text, or None if merging never ends there."""
        parts = [self.rank.get(c) for c in text]
        words = list(text)
        while len(words) > 2 and None not in parts:
            best = min(((self.rank.get(a + b, _NO_LIMIT), k) for k, (a, b) in enumerate(zip(words, words[1:], strict=False))))
            if best[0] == _NO_LIMIT:
                return None
            k = best[1]
            words[k : k + 2] = [words[k] + words[k + 1]]
            parts[k : k + 2] = [best[0]]
        return (parts[0], parts[1]) if len(parts) == 2 and None not in parts else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay as they are: taking both apart, no earlier merge joins across their border."""
        key = (a, b)
        if (known := self.stable.get(key)) is not None:
            return known
        limit, fits = _NO_LIMIT, True
        while True:
            joined = self.made.get((a, b))
            if joined is not None and joined < limit:
                fits = False
                break
            left, right = self.split.get(a), self.split.get(b)
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                break
        if len(self.stable) < REMEMBERED // 2:
            self.stable[key] = fits
        return fits

    def table(self, segment: str) -> list[int]:
        """Ids of one segment from its table of last tokens."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for text, value in self.matches.items():
                self.automaton.add_word(text, value)
            self.automaton.make_automaton()
        last: list[tuple[int, int] | None] = [None] * (len(segment) + 1)
        for end, match in self.automaton.iter(segment):
            if last[end + 1] is None:
                before = last[end + 1 - match[1]]
                if before is None or self.compatible(before[0], match[0]):  # None: the start, or a character without a piece
                    last[end + 1] = match
        out, at = [], len(segment)
        while at:
            if last[at] is None:
                out += [self.byte_ids[b] for b in reversed(segment[at - 1].encode())]
                at -= 1
            else:
                r, n = last[at]
                out.append(self.ids[r])
                at -= n
        return out[::-1]

    def segment(self, text: str) -> tuple[str, int, str]:
        """Ids as text, their number, the decoded text."""
        known = self.known.get(text)
        if known is None:
            cuts = [k for k in range(1, len(text)) if (text[k - 1], text[k]) not in self.pairs]
            if cuts:
                parts = [self.segment(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
                known = " ".join([p[0] for p in parts]), sum([p[1] for p in parts]), "".join([p[2] for p in parts])
            else:
                ids = self.table(text)
                known = " ".join(map(str, ids)), len(ids), self.plain(ids)
            if len(self.known) < REMEMBERED and len(text) <= LONGEST:
                self.known[text] = known
        return known

    def segments(self, text: str):
        """The segments of a text that is not empty."""
        marked = text.replace(" ", MARK)
        if not self.by_word:
            return [MARK + marked]
        words = marked.split(MARK)
        if "" not in words:
            return [MARK + w for w in words]
        out, run = [], ""
        for w in words:
            run += MARK
            if w:
                out.append(run + w)
                run = ""
        return out + ([run] if run else [])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for s in self.segments(text) for i in self.segment(s)[0].split()] if text else []

    def plain(self, ids: list[int]) -> str:
        """Pieces and bytes as text, with spaces for marks; control ids are silent."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.surface[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.plain(ids).removeprefix(" ")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each model file and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _digest_batches(enc: Encoder):
    def run(batches):
        # What a task remembers goes with the task, as other operators' tasks come to the same worker.
        enc._forget()
        known, segment = enc.known, enc.segment
        end = str(enc.end)
        for batch in batches:
            counts, ids, plain = [], [], []
            for text in batch.column("text").to_pylist():
                found = [known.get(s) or segment(s) for s in enc.segments(text)] if text else []
                counts.append(sum([x[1] for x in found]) + 1)
                ids.append(hashlib.sha256(" ".join([*[x[0] for x in found], end]).encode()).hexdigest())
                plain.append(hashlib.sha256("".join([x[2] for x in found]).removeprefix(" ").encode()).hexdigest())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], [*kept, "n_tokens", "ids_sha256", "decoded_sha256"])
        known.clear()
        enc._forget()

    return run


def _id_batches(enc: Encoder):
    def run(batches):
        enc._forget()
        for batch in batches:
            ids = [[*enc.encode(t), enc.end] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids (with the end id). Null and empty texts give the end id alone."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_id_batches(encoder(path)), "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole text with an end id, one row each.

    Null and empty texts give the end id alone and decode to the empty text. Repeated rows give equal rows, a null doc_id stays
    null, other columns are not read, empty tables give empty results.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digest_batches(encoder(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
