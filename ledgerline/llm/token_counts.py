"""Token counts with a whole-token shortcut.

Which strings of the vocabulary encode alone as exactly one token is proved once with the library itself. A pre-token
found among them counts 1 without any merging; only the other pre-tokens are merged, by the library's own model.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII white space. The tokenizer drops it and no token spans it, so the runs between can be counted one by one.
RUNS = re.compile(r"[^\x20\x09-\x0D]+")
#: Code points below U+0250 have no marks to compose, and their lower case is one letter each.
PLAIN = re.compile("[\t-\r !-~\u00a1-\u012f\u0131-\u024f]+")


def _plain(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(0x21, 0x250) if unicodedata.category(chr(c))[0] == kind)


#: This tokenizer's pre-tokens within the plain code points: letters, an English ending, one digit, or other signs.
PIECES = re.compile(f"[{_plain('L')}]+|'(?:[stmd]|re|ve|ll)|[{_plain('N')}]|[^\\s{_plain('L')}{_plain('N')}]+")
KNOWN_LIMIT = 1_000_000  # remembered pre-tokens; beyond it the memory starts afresh, results stay the same


def _byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the rest is moved up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenCounter:
    """Counts tokens of texts as ``tokenizers`` would, without begin, end or other added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.alphabet = _byte_alphabet()
        self.letters = {b: c for c, b in self.alphabet.items()}
        self.whole = self._prove_whole_tokens()
        self.known = dict.fromkeys(self.whole, 1)

    def _prove_whole_tokens(self) -> frozenset[str]:
        """Vocabulary strings that the library encodes alone as one token and splits no further."""
        texts = []
        for token in self.library.get_vocab(with_added_tokens=False):
            try:
                texts.append(bytes(self.alphabet[c] for c in token.removesuffix("</w>")).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        texts = sorted({t for t in texts if t})
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return frozenset(t for t, e in zip(texts, encoded) if len(e.ids) == 1 and self.pre_tokens(t) == [t])

    def pre_tokens(self, text: str) -> list[str]:
        """The library's pre-tokens, as text."""
        if PLAIN.fullmatch(text):  # here the library's normaliser only lowers letters
            return PIECES.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.alphabet[c] for c in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _merge(self, pieces: set[str]) -> None:
        """Remember the tokens of pre-tokens that no single token covers."""
        for piece in pieces:
            name = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            self.known[piece] = len(self.library.model.tokenize(name))

    def _count(self, pieces: list[str]) -> int:
        try:
            return sum(map(self.known.__getitem__, pieces))
        except KeyError:
            if len(self.known) > KNOWN_LIMIT:
                self.known = dict.fromkeys(self.whole, 1)
            self._merge(set(pieces).difference(self.known))
            return sum(map(self.known.__getitem__, pieces))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        special = any(s in text for s in self.specials)
        if not special and PLAIN.fullmatch(text):
            return self._count(PIECES.findall(text.lower()))
        plain, total = [], 0
        for run in RUNS.findall(text):
            if special and any(s in run for s in self.specials):  # the library's own handling of special strings
                total += len(self.library.encode(run, add_special_tokens=False).ids)
            elif PLAIN.fullmatch(run):
                plain.append(run)
            else:
                total += self._count(self.pre_tokens(run))
        return total + self._count(PIECES.findall(" ".join(plain).lower()))


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens and whether the count is over ``limit``.

    ``tokenizer`` is a path that every executor can open. A null text counts as empty, with 0 tokens; a null doc_id
    and repeated rows are kept as they are; other columns are ignored, whatever their names. Whole texts are counted,
    in one pass without a shuffle.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = counter(tokenizer)
        for texts in batches:
            yield pd.Series([tokens.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
