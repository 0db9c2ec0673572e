"""SentencePiece encoding and decoding by exact backtracking.

A sequence of pieces is the merge result of a text exactly if every piece is the merge result of its own
text and every two neighbours are *compatible*: merging their joined text again gives the same two.  (The
first merge that crossed a border would also cross it when only the two neighbours are merged, because
merges go by score, then from the left, and the order inside a stretch does not depend on the rest.)
So there is one such sequence, and it can be found from the left: take the longest piece that an
Aho-Corasick automaton found at this position, go on while it is compatible with the piece before, else
try the next shorter one, else step back.  Positions from which no sequence was found are kept in a
bitfield and not tried again.

Texts are cut where no piece can span: before a space that follows a non-space, around characters that no
piece holds, and between two characters that are neighbours in no piece.  The parts are encoded one by one
and kept in a bounded table, as words come again and again.

Scope: models of type BPE with identity normalisation and byte fallback; others raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


class Memo(dict):
    """Key -> value, computed when first asked for; emptied when it holds about ``limit`` bytes."""

    def __init__(self, make, size, limit: int):
        self.make, self.size, self.limit = make, size, limit
        self.held = 0

    def __missing__(self, key):
        value = self.make(key)
        if (size := self.size(key, value)):
            if self.held + size > self.limit:
                self.clear()
                self.held = 0
            self.held += size
            self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder for one model file; ``limit`` bounds the bytes of each table of what is already known."""

    def __init__(self, model_file: str, limit: int = 72 << 20):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with identity normalisation are supported")
        if not model.trainer_spec.byte_fallback or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models with byte fallback, a dummy prefix and escaped white space are supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.reference = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
        self.ids = {piece: i for piece, (_, i) in self.rank.items()}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.auto = ahocorasick.Automaton()
        for piece in self.ids:  # a piece that is not its own merge result is in no result
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.auto.add_word(piece, (len(piece) - 1, piece))
        self.auto.make_automaton()
        self.compatible = Memo(lambda ab: self.merge(ab[0] + ab[1]) == list(ab), lambda ab, _: 120, limit // 3)
        self.parts = Memo(self._joined, lambda p, x: 110 + 2 * len(p) + len(x) if len(p) <= 64 else 0, limit)
        self.cut = re.compile(self._cut_pattern())
        self.token_text = [str(i) for i in range(len(self.pieces))]
        self.token_bytes = [
            bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else b" \xe2\x81\x87 " if t == 2 else p.replace(SPACE, " ").encode()
            for p, t in zip(self.pieces, self.types, strict=True)
        ]

        self.bytes_of = dict(zip(self.token_text, self.token_bytes, strict=True))

    # -- cutting a text into parts that no piece spans

    def _cut_pattern(self) -> str:
        """Parts: spaces + rest of the word; shorter where the vocabulary allows it."""
        follows = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        held = {c for p in self.ids for c in p}
        if any(b == SPACE and a != SPACE for a, b in follows) or "\n" in held:
            return r"(?s:.+)"  # nothing is known to end a piece
        letter = re.compile(f"[{LETTERS}]")
        stop = [c for c in PUNCT if not any(b == c and letter.match(a) for a, b in follows)]
        stops = "".join(re.escape(c) for c in stop)
        return rf"{SPACE}*[{LETTERS}]+(?=[{SPACE}\n{stops}]|\Z)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"

    # -- merging, for the compatibility check

    def merge(self, text: str) -> list[str]:
        """Plain merging by score, then position: the definition that the backtracking must agree with."""
        sym: list[str | None] = list(text)
        nxt, prev = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(sym) and (r := self.rank.get(sym[i] + sym[j])):
                heapq.heappush(heap, (r[0], i, j, sym[i] + sym[j]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or nxt[i] != j or sym[i] + sym[j] != piece:
                continue
            sym[i], sym[j] = piece, None
            nxt[i] = nxt[j]
            if nxt[j] < len(sym):
                prev[nxt[j]] = i
            offer(prev[i], i)
            offer(i, nxt[i])
        return [s for s in sym if s is not None]

    # -- backtracking

    def split(self, text: str) -> list[str]:
        """Pieces of one part; a character in no piece stands for itself."""
        n = len(text)
        at: list[list[str]] = [[] for _ in range(n)]
        for end, (back, piece) in self.auto.iter(text):
            at[end - back].append(piece)  # by growing end: the longest is last
        compatible = self.compatible
        out: list[str] = []
        tries: list[int] = []
        failed = 0  # bit p: no sequence goes on from position p
        pos, k, before = 0, -1, None  # k: where to go on in the matches at this position, -1: at the longest
        while pos < n:
            found = at[pos] or [text[pos]]
            if k < 0:
                k = len(found) - 1
            while k >= 0:
                piece = found[k]
                if (before is None or compatible[before, piece]) and not (failed and failed >> (pos + len(piece)) & 1):
                    break
                k -= 1
            if k >= 0:
                out.append(piece)
                tries.append(k)
                pos += len(piece)
                before, k = piece, -1
                continue
            while True:  # no match goes on from here: step back to a position with a shorter match
                failed |= 1 << pos
                if not out:
                    raise ValueError(f"no sequence of pieces for {text!r}")
                pos -= len(out.pop())
                k = tries.pop() - 1
                before = out[-1] if out else None
                if k >= 0:
                    break
        return out

    def part_ids(self, part: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split(part):
            i = self.ids.get(piece)
            if i is None:
                ids += [self.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(i)
        return ids

    def _joined(self, part: str) -> str:
        return ",".join([self.token_text[i] for i in self.part_ids(part)])

    def encode_joined(self, text: str | None) -> tuple[str, int]:
        """The decimal ids of a whole text, joined by commas, and their number."""
        if not text:
            return "", 0
        joined = ",".join(map(self.parts.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))
        return joined, joined.count(",") + 1

    def encode(self, text: str | None) -> list[int]:
        joined, _ = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> str:
        """What :func:`decode` gives for ids that :func:`encode_joined` wrote; no integers are made."""
        if not joined:
            return ""
        parts = joined.split(",")
        try:
            text = b"".join(map(self.bytes_of.__getitem__, parts)).decode()
        except UnicodeDecodeError:
            return self.decode([int(x) for x in parts])
        return text[1:] if self.pieces[int(parts[0])].startswith(SPACE) else text

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, bytes gathered, the dummy prefix taken off."""
        if not ids:
            return ""
        raw = b"".join(map(self.token_bytes.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # bytes of no character, which encode() never gives
            return self.reference.decode(ids)
        first = next((i for i in ids if self.types[i] != 3), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


_codecs: dict[tuple[str, int], PieceCodec] = {}


def codec(model_file: str, limit: int = 72 << 20) -> PieceCodec:
    """One codec for each worker process, kept between batches and tasks."""
    key = (model_file, limit)
    if key not in _codecs:
        _codecs[key] = PieceCodec(model_file, limit)
    return _codecs[key]


def _model_path(model: str) -> str:
    return model if "/" in model else common.tokenizer_file(model)


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) + ``ids`` array<int> + ``decoded`` string.

    Every whole text is encoded.  A null text has no ids and decodes to "", as an empty one does.  Repeated
    rows give repeated results; an empty table gives an empty one.  Columns called ``ids`` or ``decoded`` in
    the input are replaced.
    """
    from pyspark.sql import types as T

    common.small_batches(docs.sparkSession)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("ids", "decoded")]
    src = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([*[src.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches):
        c = codec(_model_path(model))
        for b in batches:
            ids = [c.encode(t) for t in b.column(text).to_pylist()]
            cols = [b.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], names=[*keep, "ids", "decoded"])

    return src.mapInArrow(run, schema)


def encode_checked(docs: DataFrame, keep: list[str], model: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """``keep`` columns + ``ids`` array<int> + ``n_tokens`` long + ``round_trip``: whether the ids decode to the text.

    As :func:`encode_documents`, but the comparison is made where the text is, so no text leaves Python.  The
    library writes a space for U+2581, so a text that holds one does not come back.  Columns of ``docs`` with the
    three names are replaced.
    """
    common.small_batches(docs.sparkSession)
    keep = [c for c in keep if c not in ("ids", "n_tokens", "round_trip")]
    own = common.unused("_coded", docs.columns)

    def run(texts: pa.Array) -> pa.Array:
        c = codec(_model_path(model))
        ids, n, back = [], [], []
        for t in texts:  # one text as Python objects at a time
            t = t.as_py() or ""
            joined, k = c.encode_joined(t)
            n.append(k)
            back.append(c.decode_joined(joined) == t)
            ids.append(np.array(joined.split(",") if k else [], np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(n, pa.int64()), pa.array(back, pa.bool_())], names=["ids", "n_tokens", "round_trip"])

    coded = docs.select(*[f"`{c}`" for c in keep], F.arrow_udf(run, "ids array<int>, n_tokens long, round_trip boolean")(F.col(f"`{text}`")).alias(own))
    return coded.select(*[f"`{c}`" for c in keep], f"{own}.*")


def digests(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text: what encode_documents gives, hashed in place."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        c = codec(_model_path(model))
        sha = hashlib.sha256
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                joined, k = c.encode_joined(t)
                n.append(k)
                a.append(sha(joined.encode()).hexdigest())
                d.append(sha(c.decode_joined(joined).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
