"""Byte pair encoding of whole texts with a given vocabulary, and back."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, table

#: The pattern that byte-level vocabularies split texts by, as published with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are merged together; pieces that a worker remembers, and the longest of them.
PART, REMEMBERED, SHORT = 1 << 20, 1 << 17, 64
#: Lists of so many places and more are merged at once.
FEW = 24
#: A vocabulary file is sent to all tasks; it may have so many bytes.
MOST_BYTES = 64 << 20


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Vocabulary:
    """Byte-level BPE from the JSON form of a tokenizer: ids of bytes, ranks of pairs, bytes of ids, and added tokens."""

    def __init__(self, raw: bytes):
        given = json.loads(raw)
        model, split, added = given["model"], given.get("pre_tokenizer") or {}, given.get("added_tokens") or []
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or given.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.of_byte = np.array([ids[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: left id << 32 | right id -> rank; and by rank the left, the right and the merged id.
        self.made = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(self.made)}
        ordered = sorted(self.rank.items()) or [(-1, -1)]
        self.keys, self.key_ranks = (np.array(x, np.int64) for x in zip(*ordered, strict=True))
        #: Ranks of pairs that are merged place by place: of twice the same symbol, or making a symbol that a lower rank takes.
        least: dict[int, int] = {}
        for r, (a, b, _) in enumerate(self.made):
            least.setdefault(a, r), least.setdefault(b, r)
        self.in_order = {r for r, (a, b, new) in enumerate(self.made) if a == b or least.get(new, r) < r}
        #: By two bytes: the rank of the pair, or -1.
        self.byte_pairs = np.array([[self.rank.get(a << 32 | b, -1) for b in self.of_byte.tolist()] for a in self.of_byte.tolist()], np.int64)
        back = {c: b for b, c in enumerate(letters)}
        words = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in added}
        of = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for i, t in words.items()}
        self.bytes_of = [of.get(i, b"") for i in range(max(of, default=-1) + 1)]
        self.added = {t["content"]: t["id"] for t in added if t["content"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.breaks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece, none of which is empty.

        All pieces lie in one row of symbols. An index has the places of each pair that can be merged; the lowest rank in it
        is taken out and merged at all its places, and the pairs to both sides of each place enter their own lists. Long lists are
        merged at once in NumPy; short ones, pairs of twice the same symbol and those that can make a pair of lower rank,
        place by place from left to right.
        """
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        n = int(sizes.sum())
        # The last place stands for none: beyond the ends of the pieces.
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = np.append(self.of_byte[raw], -1)
        follows, leads = np.arange(1, n + 2), np.arange(-1, n)
        follows[ends - 1], leads[ends - sizes], follows[n] = n, n, n
        some = np.flatnonzero(follows[:n] < n)
        ranks = self.byte_pairs[raw[some], raw[some + 1]] if len(some) else some
        some, ranks = some[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        some, ranks = some[order], ranks[order]
        cuts = [*np.flatnonzero(np.diff(ranks, prepend=-1)).tolist(), len(some)]
        given = {int(ranks[a]): some[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
        index: dict[int, list[int]] = {r: [] for r in given}
        active = list(index)
        heapq.heapify(active)
        state = memoryview(symbols), memoryview(follows), memoryview(leads)

        def enter(r: int, i: int) -> None:
            places = index.get(r)
            if places is None:
                places = index[r] = []
                heapq.heappush(active, r)
            places.append(i)

        while active:
            now = heapq.heappop(active)
            places, first = index.pop(now), given.pop(now, None)
            total = len(places) + (0 if first is None else len(first))
            if total < FEW or now in self.in_order:
                places = sorted(places) if first is None else sorted([*first.tolist(), *places])
                self._one_by_one(now, places, state, n, index, enter)
                continue
            at = np.array(places, np.int64) if first is None else np.concatenate([first, np.array(places, np.int64)])
            left, right, new = self.made[now]
            at = np.unique(at) if places else at
            at = at[(symbols[at] == left) & (symbols[follows[at]] == right)]
            gone = follows[at]
            after = follows[gone]
            symbols[at], symbols[gone], follows[at] = new, -1, after
            leads[after] = at
            before = leads[at]
            # Keys beyond an end have a part of -1 and are in no vocabulary.
            for keys, where in (((new << 32) + symbols[after], at), ((symbols[before] << 32) + new, before)):
                found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                known = self.keys[found] == keys
                for r, i in zip(self.key_ranks[found[known]].tolist(), where[known].tolist(), strict=True):
                    enter(r, i)
        kept = np.flatnonzero(symbols[:n] >= 0)
        cuts = np.searchsorted(kept, np.concatenate([[0], ends])) * 4
        packed = symbols[kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _one_by_one(self, now: int, places: list[int], state: tuple, n: int, index: dict, enter) -> None:
        symbols, follows, leads = state
        left, right, new = self.made[now]
        rank = self.rank.get
        for k, i in enumerate(places):
            j = follows[i]
            if symbols[i] != left or symbols[j] != right:
                continue  # an earlier merge has taken one of the two
            after, before, lowest = follows[j], leads[i], now
            symbols[i], symbols[j], follows[i] = new, -1, after
            if after < n:
                leads[after] = i
                if (r := rank(new << 32 | symbols[after])) is not None:
                    enter(r, i)
                    lowest = r if r < lowest else lowest
            if before < n and (r := rank(symbols[before] << 32 | new)) is not None:
                enter(r, before)
                lowest = r if r < lowest else lowest
            if lowest < now:  # the new pair goes first
                for rest in places[k + 1 :]:
                    enter(now, rest)
                return

    def split(self, text: str) -> list[str]:
        """Pieces in order; added tokens are pieces of their own."""
        if self.breaks is None:
            return self.pieces.findall(text)
        found: list[str] = []
        for k, part in enumerate(self.breaks.split(text)):
            found += [part] if k % 2 else self.pieces.findall(part)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null: none. Texts of a part are merged together, each distinct piece once."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= PART):
                size += len(texts[end] or "")
                end += 1
            split = [self.split(t) if t else [] for t in texts[at:end]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list(set().union(*split).difference(self.known))
            plain = [p for p in new if p not in self.added]
            self.known.update(zip(plain, self.merged([p.encode("utf-8", "surrogatepass") for p in plain]), strict=True))
            self.known.update((p, np.array([self.added[p]], "<u4").tobytes()) for p in new if p in self.added)
            out += [b"".join(map(self.known.__getitem__, s)) for s in split]
            for p in new:
                if len(p) > SHORT:
                    del self.known[p]
            at = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; unknown ids give nothing, and bytes that are no UTF-8 the replacement character."""
        ids = ids[ids < len(self.bytes_of)]
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def decode_packed(self, ids: bytes | None) -> str:
        return self.decode(np.frombuffer(ids or b"", "<u4"))


@functools.lru_cache(maxsize=2)
def _parsed(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in pieces of about PART bytes, so that few texts are Python strings at a time."""
    piece = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts[a:b]


def _sent(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"a vocabulary of over {MOST_BYTES} bytes")
    _parsed(raw)  # what is wrong with it shows here
    return spark.sparkContext.broadcast(raw)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus ``out``: the text's token ids, packed as little-endian unsigned 32-bit integers, four bytes a token.

    ``path`` is the JSON file of a byte-level BPE vocabulary, which the driver reads and sends to the tasks (64 MB at most). Whole texts are
    encoded, however long; null and empty ones give no ids. Added tokens in a text count as such. Each row is encoded by itself:
    repeated rows and ids are no matter, an empty table gives an empty one, and a column of the name ``out`` is replaced.
    """
    raw = _sent(docs.sparkSession, path)

    @F.arrow_udf("binary")
    def encoded(texts: pa.Array) -> pa.Array:
        v = _parsed(raw.value)
        return pa.chunked_array([pa.array(v.encode(p.to_pylist()), pa.binary()) for p in _parts(texts)], pa.binary()).combine_chunks()

    return docs.withColumn(out, once(encoded)(F.col(text_col).cast("string")))


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns plus ``out``: the text of packed ids, added tokens included. Null and no ids: an empty text. A column of the name ``out`` is replaced."""
    raw = _sent(encoded.sparkSession, path)

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        v = _parsed(raw.value)
        return pa.array(map(v.decode_packed, ids.to_pylist()), pa.string())

    return encoded.withColumn(out, once(decoded)(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns plus ids and decoded, as encode_texts and then decode_ids give them, in one pass and so in one Python worker a task."""
    raw = _sent(docs.sparkSession, path)

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        v, found = _parsed(raw.value), []
        for p in _parts(texts):
            ids = v.encode(p.to_pylist())
            found.append(pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(v.decode_packed, ids), pa.string())], ["ids", "decoded"]))
        kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])
        return pa.chunked_array(found, kind).combine_chunks()

    plain = docs.withColumn("_own_text", F.col(text_col).cast("string")).drop(*[c for c in ("ids", "decoded", "_both") if c != text_col])
    keep = [c for c in plain.columns if c not in ("_own_text", "ids", "decoded")]
    return plain.withColumn("_both", once(both)(F.col("_own_text"))).select(*keep, "_both.ids", "_both.decoded")


def ids_array(packed):
    """Packed ids as array<long>, for those who want them one by one."""

    @F.arrow_udf("array<long>")
    def unpacked(ids: pa.Array) -> pa.Array:
        return pa.array([None if i is None else np.frombuffer(i, "<u4").tolist() for i in ids.to_pylist()], pa.list_(pa.int64()))

    return unpacked(packed)


def op12_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    found = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
