"""Personal data by weak supervision.

Candidates are spans of known forms (email, ip, card, phone), which always stay, and looser ones: masked e-mail addresses,
phone numbers without a country code, account numbers (IBAN), social security numbers, and names after a form of address.
Labelers vote on every candidate for or against, or abstain: the strict form, a checksum, gazetteers (first names, top-level
domains, country codes), words before and after the span, and the digits themselves.

Nobody labelled anything, so the labelers' reliabilities are estimated: expectation-maximisation over a two-class model in
which each labeler has its own probabilities of a vote given the class. It needs only how often each pattern of votes occurs,
which Spark counts over all candidates of the corpus. The classes it assigns train the final classifier, a logistic
regression on the shape of the span and its surroundings, again on counts per combination of feature values. Both tables are
bounded by the labelers and features, not by the corpus. Loose candidates stay if the classifier gives them at least
``least``. Texts are read once; candidates with votes and features are written to the shared folder.

Defined results: a null or empty text has no spans. Places count code points, the end is exclusive. Of overlapping loose
candidates the first and longest counts, and none that touches a span of a known form. Without candidates nothing is fitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import Ranges, small_batches, unused, without

BASE = ("email", "ip", "card", "phone")
LOOSE = ("masked_email", "local_phone", "iban", "ssn", "name")
KINDS = BASE + LOOSE
LABELERS = ("form", "checksum", "gazetteer", "before", "after", "digits")
FEATURES = ("kind", "digits", "length", "signs", "cue", "edge")
#: number of values of each feature
VALUES = (len(KINDS), 5, 4, 3, 3, 2)
CANDIDATES = "array<struct<kind:string,start:int,end:int,value:string,votes:string,features:array<int>>>"

# fixed patterns and word lists
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MASKED = r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}){1,4}"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?"
FOR = {
    "email": ("mail", "contact", "write", "reach", "address"), "phone": ("call", "phone", "tel", "fax", "mobile", "contact", "dial"),
    "ip": ("ip", "address", "host", "from", "login", "client"), "card": ("card", "visa", "credit", "debit", "paid", "payment"),
    "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security", "tax"), "name": ("dear", "signed", "contact", "name", "by"),
}
AGAINST = ("version", "isbn", "order", "invoice", "item", "sku", "page", "issue", "release", "build", "model", "part", "serial", "doi")
FIRST_NAMES = frozenset(
    "anna anne antonio carlos carmen charles daniel david elena emma eva francisco hans helga ines james jan jean john jose juan julia karl "
    "laura louis lucia luis manuel maria marie mark martin mary michael monika nicole olivier paul pedro peter pierre robert sabine sara sophie "
    "stefan susan thomas ursula william".split()
)
DOMAINS = frozenset("com net org edu gov int info biz io de fr es it nl uk eu ch at be pl us ca au jp cn in br mx ru se no dk fi pt".split())
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB HU IE IT LU NL NO PL PT SE".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether digits, however many, name a number up to 255."""
    rest = part.lstrip("0")
    return len(rest) <= 3 and int(rest or 0) <= 255


def iban_rest(value: str) -> int:
    s = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


class Finder:
    def __init__(self):
        self.domain, self.ip, self.card, self.phone = (re.compile(p) for p in (DOMAIN, IP, CARD, PHONE))
        self.loose = [(k, re.compile(p)) for k, p in zip(LOOSE, (MASKED, LOCAL_PHONE, IBAN, SSN, NAME))]
        self.word = re.compile(r"[a-z]+")

    def emails(self, text: str) -> Iterator[tuple[int, int]]:
        """A match has one @ behind a whole run of local characters; so every @ is looked at once, whatever the run."""
        floor, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            m = self.domain.match(text, at + 1) if start < at else None
            floor = m.end() if m else at + 1
            if m:
                yield start, floor
            at = text.find("@", floor)

    def known(self, text: str) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the known forms; a match that fails its test is dropped."""
        found = [(0, a, b) for a, b in self.emails(text)]
        found += [(1, m.start(), m.end()) for m in self.ip.finditer(text) if all(small(p) for p in m[0].split("."))]
        for m in self.card.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in self.phone.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
        return found

    def candidates(self, text: str) -> list[dict]:
        found = self.known(text)
        taken, free = Ranges((a, b) for _, a, b in found), 0  # accepted candidates end before free
        wanted = sorted((m.start(), -m.end(), len(BASE) + i) for i, (_, p) in enumerate(self.loose) for m in p.finditer(text))
        for a, negative, kind in wanted:
            if a >= free and not taken.meets(a, -negative):
                free = -negative
                found.append((kind, a, free))
        return [self.judged(text, *span) for span in sorted(found)]

    def judged(self, text: str, kind: int, start: int, end: int) -> dict:
        value, name = text[start:end], KINDS[kind]
        digits = "".join(c for c in value if "0" <= c <= "9")
        before = self.word.findall(text[max(0, start - 40) : start].lower())
        after = self.word.findall(text[end : end + 20].lower())
        group = {"masked_email": "email", "local_phone": "phone"}.get(name, name)
        cue, against = any(w in FOR[group] for w in before[-5:]), any(w in AGAINST for w in before[-3:])
        edge = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
        form = 1 if kind < len(BASE) and edge else 0
        check = 0
        if name == "iban":
            check = 1 if iban_rest(value) == 1 else -1
        elif name == "ssn":
            check = 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
        elif name == "card":
            check = 1
        listed = 0
        if group == "email":
            listed = 1 if re.split(r"[^a-z]+", value.lower().rstrip(")] "))[-1] in DOMAINS else -1
        elif name == "iban":
            listed = 1 if value[:2] in COUNTRIES else -1
        elif name == "name":
            listed = 1 if any(w in FIRST_NAMES for w in self.word.findall(value.lower())) else 0
        plain = -1 if digits and (len(set(digits)) <= 2 or digits in "01234567890123456789") else 0
        votes = (form, check, listed, -1 if against else 1 if cue else 0, -1 if after[:1] and after[0] in AGAINST else 0, plain)
        signs = min(2, sum(not c.isalnum() for c in value) // 2)
        features = [kind, min(4, len(digits) // 4), min(3, len(value) // 10), signs, 2 if against else int(cue), int(edge)]
        return {
            "kind": name, "start": start, "end": end, "value": value, "votes": "".join("-0+"[v + 1] for v in votes), "features": features,
        }


def candidates(text: Column) -> Column:
    """Candidates of a text with votes and features, by kind and start."""

    @F.pandas_udf(CANDIDATES)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder()
        for batch in batches:
            yield pd.Series([finder.candidates(t) if isinstance(t, str) else [] for t in batch])

    return scan(text)


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 50) -> dict[str, float]:
    """Probability of the positive class for each pattern of votes, by expectation-maximisation from the majority vote."""
    votes = np.array([["-0+".index(c) for c in p] for p, _ in patterns])
    n = np.array([float(c) for _, c in patterns])
    total = (votes - 1).sum(axis=1)
    p = np.clip(0.5 + 0.4 * np.sign(total) * np.minimum(1, np.abs(total)), 0.05, 0.95)
    each = np.arange(3)
    for _ in range(rounds):
        positive, negative = n * p, n * (1 - p)
        prior = (positive.sum() + 1) / (n.sum() + 2)
        score = np.full(len(n), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            hit = votes[:, j, None] == each
            a = (positive @ hit + np.array([0.1, 1.0, 2.0])) / (positive.sum() + 3.1)  # a labeler is better than chance at first
            b = (negative @ hit + np.array([2.0, 1.0, 0.1])) / (negative.sum() + 3.1)
            score += np.log(a / b)[votes[:, j]]
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return {pattern: float(x) for (pattern, _), x in zip(patterns, p)}


def columns_of(features) -> list[int]:
    """Places of the feature values in the weight vector."""
    starts = np.cumsum((0,) + VALUES[:-1])
    return [int(s) + int(f) for s, f in zip(starts, features)]


def classifier(rows: list[tuple[list[int], float, float]], steps: int = 300, rate: float = 0.5, keep: float = 1e-3) -> list[float]:
    """Weights of a logistic regression; rows are (features, count, mean probability). The last weight is the constant."""
    x = np.zeros((len(rows), sum(VALUES) + 1))
    for i, (features, _, _) in enumerate(rows):
        x[i, columns_of(features)] = 1
    x[:, -1] = 1
    n, y = np.array([float(r[1]) for r in rows]), np.array([r[2] for r in rows])
    n /= n.sum()
    w, slope = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        g = x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + keep * w
        slope += g * g
        w -= rate * g / np.sqrt(slope)
    return w.tolist()


def find_personal_data(
    df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "personal", least: float = 0.9
) -> DataFrame:
    """The columns ``keep`` and the spans (kind, start, end, value, probability) of each text, by kind as listed and start."""
    small_batches(df.sparkSession)
    (tmp,) = unused(df.select(*keep), "_found")
    rows = materialize(df.select(*[F.col(f"`{c}`") for c in keep], candidates(F.col(text_col)).alias(tmp)), "personal-candidates")
    each = rows.select(F.explode(tmp).alias("c")).select("c.votes", "c.features")
    table = each.groupBy("votes", "features").count().collect()  # at most patterns of votes x feature values
    weights = [0.0] * (sum(VALUES) + 1)
    if table:
        counts: dict[str, int] = {}
        for r in table:
            counts[r.votes] = counts.get(r.votes, 0) + r["count"]
        p = reliabilities(sorted(counts.items()))
        sums: dict[tuple[int, ...], list[float]] = {}
        for r in table:
            s = sums.setdefault(tuple(r.features), [0.0, 0.0])
            s[0] += r["count"]
            s[1] += r["count"] * p[r.votes]
        weights = classifier([(list(f), n, total / n) for f, (n, total) in sorted(sums.items())])
    starts = F.array(*[F.lit(int(s)) for s in np.cumsum((0,) + VALUES[:-1])])
    w = F.array(*[F.lit(x) for x in weights])

    def scored(c: Column) -> Column:
        logit = F.aggregate(F.zip_with(starts, c["features"], lambda s, f: F.get(w, s + f)), F.lit(float(weights[-1])), lambda a, x: a + x)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), (1 / (1 + F.exp(-logit))).alias("probability"))

    spans = F.filter(F.transform(tmp, scored), lambda s: s["kind"].isin(*BASE) | (s["probability"] >= least))
    return rows.select(*[F.col(f"`{c}`") for c in without(rows, tmp, out).columns], spans.alias(out))
