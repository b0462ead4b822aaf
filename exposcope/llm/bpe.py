"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its
encoding: the token whose pair with the last token of the remaining prefix stays
unmerged.  The table of these last tokens is the whole state.  Walking it back
gives the ids; appending bytes only extends it; an edit only recomputes it from
the edit to the point where it agrees again with the old table over the longest
token's length.

Ranks and the splitting pattern come from a tokenizer file (never trained here).
The file is fixed-size (about 1 MB), read on the driver and broadcast as bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import map_texts, table

#: Encodings kept per Python worker: so many recent pieces and as many older ones (of at
#: most MEMO_BYTES, about 30 MB in all), and so many facts about pairs of tokens (30 MB).
MEMO_PIECES, MEMO_PAIRS = 100_000, 300_000
#: Longer pieces are encoded without the memo.
MEMO_BYTES = 64


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id from the lines ``base64 id`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


class PrefixBPE:
    """Encoder for one vocabulary (a rank for every single byte is required)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes_of = np.empty(max(ranks.values()) + 1, object)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.size_of = [len(t) if t else 0 for t in self.bytes_of]
        self.longest = max(map(len, ranks))
        #: Token -> its last (first) part at each step of its own merges; tokens
        #: that these do not rebuild are missing and can appear in no table.
        self.ends: dict[int, tuple] = {}
        self.begins: dict[int, tuple] = {}
        self.own = {t: t for t in ranks}  # parts of tokens are tokens: one object for each
        self.tokens_in = ahocorasick.Automaton()
        for t, i in ranks.items():
            if self._trace(t, i):
                self.tokens_in.add_word(t.decode("latin-1"), (len(t), i))
        self.tokens_in.make_automaton()
        self.pair_ok: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _trace(self, token: bytes, i: int) -> bool:
        """Record the parts at both ends of a token while its bytes merge, each with
        the rank of the merge that ends it; whether the merges rebuild the token."""
        never = 1 << 40
        parts = [token[k:k + 1] for k in range(len(token))]
        left, right = [[parts[0], never]], [[parts[-1], never]]
        while len(parts) > 1:
            found = [(r, k) for k in range(len(parts) - 1)
                     if (r := self.ranks.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return False
            r, k = min(found)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if k == 0:
                left[-1][1] = r
                left.append([parts[0], never])
            if k == len(parts) - 1:
                right[-1][1] = r
                right.append([parts[-1], never])
        self.begins[i], self.ends[i] = (tuple((self.own[t], r) for t, r in side) for side in (left, right))
        return True

    def merge(self, piece: bytes) -> list[int]:
        """Definition of the encoding: merge the lowest-ranked neighbours, leftmost first."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(r, k) for k in range(len(parts) - 1)
                     if (r := self.ranks.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` directly followed by ``b`` survives merging: no part at the
        end of ``a`` merges with one at the start of ``b`` while both are there.
        (At equal ranks the leftmost pair merges first.)"""
        get = self.ranks.get
        for x, x_ends in self.ends[a]:
            for y, y_ends in self.begins[b]:
                r = get(x + y)
                if r is not None and r < x_ends and r <= y_ends:
                    return False
        return True

    def _know(self, key: int) -> bool:
        if len(self.pair_ok) > MEMO_PAIRS:
            self.pair_ok.clear()
        ok = self.pair_ok[key] = self.compatible(key >> 20, key & 0xFFFFF)
        return ok

    def extend(self, last: list[int], piece: bytes, begin: int, stop=None) -> None:
        """Fill ``last[i]`` (the token ending at byte ``i``) for the bytes after
        ``begin``; ``last[0]`` is a placeholder.  ``stop(i)`` may end it early."""
        scan = max(0, begin - self.longest + 1)
        known, know, push = self.pair_ok.get, self._know, last.append
        done = begin  # prefixes up to here have their token
        for end, (size, tok) in self.tokens_in.iter(piece[scan:].decode("latin-1")):
            i = scan + end + 1
            if i <= done:
                continue
            if size < i:
                key = last[i - size] << 20 | tok
                ok = known(key)
                if not (know(key) if ok is None else ok):
                    continue
            push(tok)
            done = i
            if stop and stop(i):
                return
        if done < len(piece):
            raise ValueError("the vocabulary lacks a single byte")

    def table(self, piece: bytes) -> list[int]:
        last = [-1]
        self.extend(last, piece, 0)
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids of a table, from the last prefix back to the first."""
        ids, i = [], len(last) - 1
        while i:
            ids.append(last[i])
            i -= self.size_of[last[i]]
        return ids[::-1]

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.table(piece))

    def packed(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = array("I", self.piece_ids(piece.encode())).tobytes()
        if len(piece) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_PIECES:
                self.older, self.memo = self.memo, {}
            self.memo[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        packed = self.packed
        return b"".join([self.memo.get(p) or packed(p) for p in self.split.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.bytes_of[np.frombuffer(ids, "<u4")].tolist())


class EncodedText:
    """A text with its pieces' prefix tables, kept exact under appends and edits."""

    #: The pattern's longest fixed alternative; a piece may change up to here before an edit.
    REACH = 3

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text, self.pieces = bpe, "", []  # pieces: (start, piece, table)
        self.recomputed = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of ``text[start:end]``; tables outside the pieces
        that change are kept, a changed piece reuses the prefix it shares."""
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        keep = 0
        while keep < len(self.pieces) - 1 and \
                self.pieces[keep][0] + len(self.pieces[keep][1]) <= start - self.REACH:
            keep += 1
        head, tail = self.pieces[:keep], self.pieces[keep:]
        at = head[-1][0] + len(head[-1][1]) if head else 0
        old_at = {s: k for k, (s, _, _) in enumerate(tail)}
        spare = tail[0] if tail else None
        fresh, self.recomputed = [], 0
        rest: list = []
        for m in self.bpe.split.finditer(text, at):
            if m.start() >= start + len(new) and m.start() - shift in old_at:
                rest = [(s + shift, p, t) for s, p, t in tail[old_at[m.start() - shift]:]]
                break
            piece = m.group()
            fresh.append((m.start(), piece, self._table(piece, spare)))
            spare = None
        self.text, self.pieces = text, head + fresh + rest

    def _table(self, piece: str, old) -> list[int]:
        data = piece.encode()
        if old is None:
            self.recomputed += len(data)
            return self.bpe.table(data)
        before, known = old[1].encode(), old[2]
        same = 0
        while same < min(len(data), len(before)) and data[same] == before[same]:
            same += 1
        back = 0
        while back < min(len(data), len(before)) - same and data[-1 - back] == before[-1 - back]:
            back += 1
        last, off, run = known[:same + 1], len(before) - len(data), 0

        def agreed(i: int) -> bool:
            nonlocal run
            run = run + 1 if i > len(data) - back and last[i] == known[i + off] else 0
            return run >= self.bpe.longest

        self.bpe.extend(last, data, same, agreed)
        self.recomputed += len(last) - 1 - same
        return last + known[len(last) + off:]

    def ids(self) -> list[int]:
        out: list[int] = []
        for _, piece, last in self.pieces:
            whole = self.bpe.ranks.get(piece.encode())
            out += [whole] if whole is not None else self.bpe.walk(last)
        return out


@functools.lru_cache(maxsize=2)
def _encoder(digest: str, pattern: str, holder) -> PrefixBPE:
    return PrefixBPE(parse_ranks(holder.data), pattern)


class _Vocabulary:
    """The rank file's bytes; equal files share one encoder per Python worker."""

    def __init__(self, data: bytes, pattern: str):
        self.data, self.pattern, self.digest = data, pattern, hashlib.sha256(data).hexdigest()

    def __hash__(self):
        return hash(self.digest)

    def __eq__(self, other):
        return self.digest == other.digest

    def encoder(self) -> PrefixBPE:
        return _encoder(self.digest, self.pattern, self)


def load_vocabulary(spark: SparkSession, ranks_path: str, pattern: str):
    """Broadcast a rank file (read on the driver; at most 64 MB is accepted)."""
    with open(ranks_path, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError(f"{ranks_path} is no tokenizer file")
    return spark.sparkContext.broadcast(_Vocabulary(data, pattern))


def encode_texts(df: DataFrame, vocabulary, text_col: str = "text", keep=("doc_id",),
                 out: str = "ids") -> DataFrame:
    """``keep`` columns plus ``out``: the ids of the whole text as a binary column
    of little-endian unsigned 32-bit integers.

    A null or empty text gives zero ids; a null key stays null; repeated rows
    give repeated rows; an empty table an empty result; other columns (whatever
    their names) are not carried unless listed in ``keep``.
    """
    def make():
        enc = vocabulary.value.encoder()
        return lambda texts: [(enc.encode(t) if t else b"",) for t in texts]

    return map_texts(df, text_col, list(keep), f"{out} binary", make)


def decode_ids(df: DataFrame, vocabulary, ids_col: str = "ids", keep=("doc_id",),
               out: str = "decoded") -> DataFrame:
    """``keep`` columns plus ``out``: the bytes that the ids stand for (null ids: none).
    An id beyond the vocabulary raises IndexError."""
    def make():
        enc = vocabulary.value.encoder()
        return lambda values: [(enc.decode(v) if v else b"",) for v in values]

    return map_texts(df, ids_col, list(keep), f"{out} binary", make)


def round_trip(docs: DataFrame, vocabulary) -> DataFrame:
    """Encode, then decode the ids: doc_id, ids, n_tokens, ids_sha256, decoded.

    Both happen in one map, so that a core has one Python worker with one encoder;
    the text is decoded from the ids as they are stored.  A null or empty text gives
    zero ids and zero bytes; null ids of rows stay, repeated rows repeat, an empty
    table gives an empty result; other columns, whatever their names, aren't carried.
    """
    def make():
        enc = vocabulary.value.encoder()

        def both(text):
            ids = enc.encode(text) if text else b""
            return ids, enc.decode(ids) if ids else b""
        return lambda texts: [both(t) for t in texts]

    coded = map_texts(docs, "text", ["doc_id"], "ids binary, decoded binary", make)
    return coded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), "decoded")


@query("op1_bpe_encode_decode")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    v = load_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                        public_tokenizers.PATTERN)
    return round_trip(table(spark, sf_dir, "documents"), v).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
