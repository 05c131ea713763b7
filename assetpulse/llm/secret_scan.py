"""Secret scan: known forms of secrets, and random strings found by their token efficiency.

Known forms are found by patterns, leftmost and non-overlapping per kind. Further strings are judged by how well a public
byte-pair vocabulary compresses them: words, paths and identifiers take few tokens, random strings take many. A string of
at least ``min_chars`` letters, digits and +/_= signs with at least two of digits, upper and lower case that yields fewer than
``ratio`` characters per token is a span of kind ``random``, unless it is a digest or an identifier: hexadecimal strings of
the length of a known digest, UUIDs, and names whose parts between signs, digits and changes of case are all words or short
numbers. Strings that touch a span of a known form are left to it.

The vocabulary is read on the driver and broadcast (under 1 MB); every task builds its encoder from it once.

Defined results: a null or empty text has no spans. Places count code points, the end is exclusive. Repeated rows are
scanned each on its own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import Ranges, small_batches, without

KINDS = ("assign", "access", "hex", "random")
# fixed patterns
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = r"AKIA[A-Z0-9]+"
STRING = r"[A-Za-z0-9+/_=-]{16,}"
UUID = r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512
DIGESTS = (32, 40, 56, 64, 96, 128)
#: characters of a long string that are tokenised at once
PIECE = 1024
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def vocabulary_path() -> str:
    """The public byte-level vocabulary of this environment."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder_of(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("scan", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})


class Scanner:
    def __init__(self, ranks: bytes, ratio: float, min_chars: int):
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex, self.string = re.compile(ACCESS), re.compile("[0-9a-f]{16,}"), re.compile(STRING)
        self.uuid, self.hex_only = re.compile(UUID), re.compile("[0-9a-f]+|[0-9A-F]+")
        self.parts = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
        self.encode = encoder_of(ranks).encode_ordinary
        self.ratio, self.min_chars = ratio, min_chars

    def named(self, s: str) -> bool:
        """Whether a string is a digest, a UUID or made of words and short numbers."""
        if self.hex_only.fullmatch(s) and len(s) in DIGESTS or self.uuid.fullmatch(s):
            return True
        parts = self.parts.findall(s)
        return all(len(p) <= 4 if p[0].isdigit() else len(p) >= 3 for p in parts) and sum(map(len, parts)) >= 4 * len(parts)

    def chars_per_token(self, s: str) -> float:
        return len(s) / sum(len(self.encode(s[i : i + PIECE])) for i in range(0, len(s), PIECE))

    def random(self, s: str) -> bool:
        classes = any("0" <= c <= "9" for c in s) + any("A" <= c <= "Z" for c in s) + any("a" <= c <= "z" for c in s)
        return len(s) >= self.min_chars and classes >= 2 and not self.named(s) and self.chars_per_token(s) < self.ratio

    def spans(self, text: str) -> list[tuple[str, int, int, str]]:
        found = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            for m in self.assign.finditer(text):
                if len(m[2]) >= 12:
                    found.append((m.start(), 0, m.end()))
        strings = []
        for m in self.string.finditer(text):  # what the other forms lie in
            s, at = m[0], m.start()
            if "AKIA" in s:
                for x in self.access.finditer(s):
                    if x.end() - x.start() >= 18:
                        found.append((at + x.start(), 1, at + x.end()))
            for x in self.hex.finditer(s):
                found.append((at + x.start(), 2, at + x.end()))
            if self.random(s):
                strings.append((at, 3, m.end()))
        taken = Ranges((a, b) for a, _, b in found)
        found += [(a, kind, b) for a, kind, b in strings if not taken.meets(a, b)]
        return [(KINDS[kind], a, b, text[a:b]) for a, kind, b in sorted(found)]


def secret_spans(text: Column, spark, vocabulary: str | None = None, ratio: float = 1.9, min_chars: int = 20) -> Column:
    """Spans (kind, start, end, value) of a text, by start and kind."""
    with open(vocabulary or vocabulary_path(), "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(ranks.value, ratio, min_chars)
        names = ("kind", "start", "end", "value")
        for batch in batches:
            yield pd.Series([[dict(zip(names, s)) for s in scanner.spans(t)] if isinstance(t, str) else [] for t in batch])

    return scan(text)


def find_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets", **options) -> DataFrame:
    """``df`` with the secret spans of each text; a column of that name is replaced."""
    small_batches(df.sparkSession)
    spans = secret_spans(F.col(text_col), df.sparkSession, **options)
    return df.select(*[F.col(f"`{c}`") for c in without(df, out).columns], spans.alias(out))
