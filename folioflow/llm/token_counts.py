"""Token counts of every prefix of a text by dynamic programming.

A byte-level BPE encoding without its last token is the encoding of a shorter prefix, and of the tokens that
a prefix ends in exactly one may follow the encoding before it. So one pass over a piece, keeping the last
token and the count at each prefix, gives the exact count of them all, in time linear in the piece. Pieces of
the vocabulary's pattern are independent of each other; a text's prefixes add a piece's counts to those before
it, save where a cut moves the border of a piece: in a run of blanks, in a contraction, in a special token.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import documents, own_name, ship, text_udf

VOCABULARY = "byte_bpe_50k"
LIMIT = 512
#: Pieces that a worker remembers before those not met lately go; pairs of tokens, after which it starts anew.
MEMO, PAIRS = 500_000, 2_000_000
#: Characters of a piece that is remembered, at most.
SHORT = 64


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letters that the vocabulary file writes bytes as: themselves if printable, the others in order from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts of one vocabulary, a tokenizers file of byte-level BPE."""

    #: Fixed value: the vocabulary's pattern, in the terms of `re`.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    #: Characters that `re` and the library may class otherwise; texts with one are split by the library.
    OTHER = re.compile(r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
    #: Blanks to the library's pattern.
    BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*")
    #: Contractions that are cut to two pieces where their last letter is missing.
    LONG = {"'re": 2, "'ve": 2, "'ll": 2}

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file)
        held, letters = json.loads(file), byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocabulary = {s: i for s, i in held["model"]["vocab"].items() if all(c in letters for c in s)}
        self.ids = {raw(s): i for s, i in vocabulary.items()}
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        self.made = {new: (rank, a, b) for rank, (a, b, new) in enumerate(merges)}
        # the vocabulary read backwards: (place, byte) -> place, and the token that a place ends
        self.back: dict[int, int] = {}
        self.token = [-1]
        for b, i in self.ids.items():
            at = 0
            for x in reversed(b):
                to = self.back.setdefault(at << 8 | x, len(self.token))
                if to == len(self.token):
                    self.token.append(-1)
                at = to
            self.token[at] = i
        special = sorted((t["content"] for t in held["added_tokens"]), key=lambda s: (-len(s), s))
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple] = {}
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}
        #: The last token, and the count, at each prefix of the piece worked on.
        self.last, self.counts = [-1], [0]

    def edge(self, token: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
        """The tokens that stand at a token's right end, and at its left, while it is made, each with the rank of the merge that takes it in."""
        known = self.edges.get(token)
        if known is None:
            sides = []
            for side in (2, 1):
                out, t, end = [], token, float("inf")
                while True:
                    out.append((t, end))
                    if t not in self.made:
                        break
                    end, t = self.made[t][0], self.made[t][side]
                sides.append(out[::-1])
            known = self.edges[token] = tuple(sides)
        return known

    def meeting(self, last: int, token: int) -> tuple[int, int] | None:
        """The pair that is merged first over the border of two tokens that stand side by side; none if they stay apart.

        Merges go by rank, and one of new tokens ranks after those that made them, so the pairs that meet while either side is made come in turn: a
        pair is merged if that ranks before either side goes on; of equal ranks the left one goes first.
        """
        left, right, ranks = self.edge(last)[0], self.edge(token)[1], self.ranks
        i = j = 0
        (a, a_ends), (b, b_ends) = left[0], right[0]
        while True:
            rank = ranks.get((a, b))
            if rank is not None and rank < a_ends and rank <= b_ends:
                return a, b
            if a_ends <= b_ends:
                i += 1
                if i == len(left):
                    return None
                a, a_ends = left[i]
            else:
                j += 1
                b, b_ends = right[j]

    def may_follow(self, last: int, token: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two; last -1: whether a token's bytes are encoded as itself."""
        key = (last + 1) << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            if last >= 0:
                known = self.meeting(last, token) is None and self.may_follow(-1, token)
            elif token in self.made:
                _, a, b = self.made[token]
                known = self.meeting(a, b) == (a, b) and self.may_follow(-1, a) and self.may_follow(-1, b)
            else:
                known = True
            self.pairs[key] = known
        return known

    def prefixes(self, piece: bytes, shared: int = 0) -> list[int]:
        """Tokens of each prefix of a piece, in bytes, from the empty one on; `shared` bytes are those of the piece before, whose prefixes stand."""
        back, tokens, pairs = self.back, self.token, self.pairs
        last, count = self.last, self.counts
        del last[shared + 1 :], count[shared + 1 :]
        for i in range(shared, len(piece)):
            at, k = 0, i
            while True:  # tokens that end here, the shortest first: one of them follows what is before it
                at = back[at << 8 | piece[k]]
                token = tokens[at]
                if token >= 0:
                    key = (last[k] + 1) << 32 | token
                    ok = pairs.get(key)
                    if self.may_follow(last[k], token) if ok is None and (not k or last[k] >= 0) else ok:
                        last.append(token)
                        count.append(count[k] + 1)
                        break
                k -= 1
        return count

    def learn(self, pieces: list[str]) -> None:
        """Totals of new pieces to memory: in order, so that each goes on from the prefix that it shares with the one before."""
        memo, before = self.memo, b""
        for piece, raw in sorted((p, p.encode()) for p in pieces):
            shared = 0
            for x, y in zip(before, raw, strict=False):
                if x != y:
                    break
                shared += 1
            memo[piece] = self.prefixes(raw, shared)[-1]
            before = raw

    def totals(self, pieces: list[str]) -> list[int]:
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        memo, older, new = self.memo, self.older, []
        for p in set(pieces):
            if p not in memo:
                if p in older:
                    memo[p] = older[p]
                else:
                    new.append(p)
        self.learn(new)
        out = list(map(memo.__getitem__, pieces))
        for p in new:
            if len(p) > SHORT:  # long ones seldom come again, and weigh
                del memo[p]
        return out

    def pieces(self, text: str) -> list[str]:
        """Of a text without special tokens, as the library splits it."""
        if not self.OTHER.search(text):
            return self.SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def stretches(self, text: str):
        """(ordinary text, whether a special token follows it, that token's length) in turn."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], m.end() - m.start()
            at = m.end()
        yield text[at:], 0

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each of some whole texts, whose new pieces are learned together."""
        pieces, ends, special = [], [], []
        for text in texts:
            if self.special is None or not self.special.search(text):
                pieces += self.pieces(text)
                special.append(0)
            else:
                parts = list(self.stretches(text))
                for ordinary, _ in parts:
                    pieces += self.pieces(ordinary)
                special.append(sum(after > 0 for _, after in parts))
            ends.append(len(pieces))
        so_far = [0, *accumulate(self.totals(pieces))]
        return [so_far[b] - so_far[a] + n for a, b, n in zip([0, *ends], ends, special, strict=False)]

    def _letters(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece in code points, from one on."""
        raw = piece.encode()
        count = self.prefixes(raw)
        return [count[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]

    def every_prefix(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text in code points, from one on: what `count` gives for each of them."""
        out: list[int] = []
        done, start = 0, 0  # tokens, and code points, before this stretch
        for ordinary, after in self.stretches(text):
            before, at, blank_at, blank_before, anchor = done, 0, None, done, (0, done)
            for piece in self.pieces(ordinary):
                m = self.BLANK.match(piece).end()
                if m:
                    if blank_at is None:
                        blank_at, blank_before = at, done
                        run = self._letters(ordinary[at : self.BLANK.match(ordinary, at).end()])
                    anchor = (blank_at, blank_before)
                    out += [blank_before + n for n in run[at - blank_at : at - blank_at + m]]
                else:
                    anchor = (at, done)
                if m < len(piece):
                    own = self._letters(piece)
                    if piece in self.LONG:
                        own[1] = self.LONG[piece]
                    out += [done + n for n in own[m:]]
                    blank_at = None
                done, at = done + self.totals([piece])[0], at + len(piece)
            if after:  # a special token that is cut is ordinary text, which may join what is before it
                a, n = anchor
                out += [n + self.count(text[start + a : start + at + k]) for k in range(1, after)] + [done + 1]
                done += 1
            start += at + after
        return np.array(out, np.int32)


@lru_cache(maxsize=1)
def counter(file: str) -> Counter:
    """A worker's counter, kept over its tasks."""
    return Counter(file)


def _counts(file: str, prefixes: bool):
    def work(buf: np.ndarray, offsets: np.ndarray) -> list:
        c, raw = counter(file), buf.tobytes()
        ends = offsets.tolist()
        texts = [raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if not prefixes:
            return [np.diff(offsets), c.count_all(texts)]
        each = [c.every_prefix(t) for t in texts]
        values = pa.array(np.concatenate([np.zeros(0, np.int32), *each]), pa.int32())
        stored = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), values)
        return [np.diff(offsets), [int(e[-1]) if len(e) else 0 for e in each], stored.cast(pa.list_(pa.field("element", pa.int32())))]

    return work


def with_token_counts(docs: DataFrame, name: str = "tokens", prefixes: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with a struct: n_bytes, n_tokens and, with `prefixes`, prefix: the count at every prefix in code points, the first's first.

    Counts are those of the vocabulary's library: special tokens are known in texts, none are added. A null or empty text has no bytes,
    no tokens and an empty `prefix`. Texts of any length are counted whole, in time linear in them. Repeated rows are counted each; a column of that name is replaced, others
    pass through. An empty table gives an empty one. Rows are worked on where they are read.
    """
    ship(docs.sparkSession)
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        file = f.read()
    kind = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())] + ([T.StructField("prefix", T.ArrayType(T.IntegerType()))] if prefixes else []))
    call, held = text_udf(_counts(file, prefixes), kind), own_name(docs, "counts")
    out = docs.withColumn(held, call(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    return out.select(*[docs[c] for c in docs.columns if c.lower() != name.lower()], F.col(held).alias(name))


def most_within(prefix: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens, from stored counts; 0 where none fits. A longer prefix may have fewer tokens, so it is the last that fits."""
    return F.coalesce(F.array_max(F.transform(prefix, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))), F.lit(0))


def truncated(text: Column, prefix: Column, budget: Column | int) -> Column:
    """The longest prefix of `text` of at most `budget` tokens, without encoding anything anew. A null text is empty."""
    return F.substring(F.coalesce(text, F.lit("")), F.lit(1), most_within(prefix, budget))


def tokens_before(prefix: Column, n_chars: Column | int) -> Column:
    """Tokens of the first `n_chars` code points, from stored counts; of the whole text where it is shorter."""
    at = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(prefix))
    return F.when(at > 0, F.try_element_at(prefix, at.cast("int"))).otherwise(F.lit(0))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_token_counts(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > LIMIT).alias("over_limit"))
