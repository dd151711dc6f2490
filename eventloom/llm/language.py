"""Language identification in two steps: the family, then the language within it.

Features are hashed counts of two and three bytes of the lower-cased letters, square
roots, scaled to length one. Families are told apart by linear support vector machines,
one against the rest; within a family every two languages have a machine of their own,
and the language with most votes wins, ties by margin. Machines are fitted on the driver
to a sample of bounded size: about PER_LANGUAGE documents of every language, those of
smallest id hash, fewer where EXAMPLES in all would be passed. Every language that occurs
is learned. Whole texts are read, for fitting and for prediction; the driver gets counts of
features only.

A null text, or one without a letter, is `und` with score 0. Rows whose lang is null teach
nothing. Without any labelled row all texts are `und`. Repeated rows get equal results; of
rows with one id and language the text of smallest hash teaches. Ties go to the first
language, by name.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_rows, stored, whole_text

BUCKETS = 4096
#: Bounds of the sample: documents per language, and in all.
PER_LANGUAGE, EXAMPLES = 500, 8_192
UNKNOWN = "und"

#: Families by ISO 639-1 code; a language of none of these is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_WORD_CHARACTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Superscripts and fractions are word characters, but no letters."""
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


#: Bytes that are no letters count as a space: ASCII but a to z.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 0
_FOLD[97:123] = np.arange(97, 123)


def counts_of(text: str) -> np.ndarray:
    codes = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
    pairs = codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(2246822519)
    triples = pairs[:-1] * np.uint32(3266489917) + codes[2:] * np.uint32(668265263)
    return np.bincount(pairs >> np.uint32(20), minlength=BUCKETS) + np.bincount(triples >> np.uint32(20), minlength=BUCKETS)


def features(text: str) -> np.ndarray:
    return scaled(counts_of(text))


def scaled(counts: np.ndarray) -> np.ndarray:
    roots = np.sqrt(counts.astype(np.float32))
    return roots / np.sqrt((roots * roots).sum())


def packed(counts: np.ndarray) -> bytes:
    """Buckets that occur and their counts."""
    at = np.flatnonzero(counts)
    return np.concatenate([at, counts[at]]).astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    at, n = np.frombuffer(data, "<u4").reshape(2, -1)
    counts = np.zeros(BUCKETS, np.int64)
    counts[at] = n
    return counts


def fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss; y is
    +1 or -1. Accelerated gradient steps on the whole sample, classes weighted alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    ahead, step = w.copy(), 0.25  # rows have length one, so the curvature is at most 4
    for k in range(rounds):
        short = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = weight * y * short
        gradient = np.append(-2 * (pull @ x) + ridge * ahead[:-1], -2 * pull.sum()).astype(np.float32)
        new = ahead - step * gradient
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


class Languages:
    """Machines fitted to texts, or rows of their features, and their languages."""

    def __init__(self, texts: list[str] | np.ndarray, langs: list[str]) -> None:
        x = texts if isinstance(texts, np.ndarray) else np.array([features(t) for t in texts], np.float32).reshape(-1, BUCKETS)
        lang = np.array(langs, dtype=object)
        family = np.array([FAMILY_OF.get(v, v) for v in langs], dtype=object)
        self.families = sorted(set(family))
        self.members = {f: sorted(set(lang[family == f])) for f in self.families}
        rest = [fit_machine(x, np.where(family == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.family_machines = np.array(rest, dtype=np.float32).reshape(len(rest), BUCKETS + 1)
        self.pairs: dict[str, list[tuple[int, int]]] = {}
        self.pair_machines: dict[str, np.ndarray] = {}
        for f, names in self.members.items():
            self.pairs[f] = list(combinations(range(len(names)), 2))
            found = []
            for a, b in self.pairs[f]:
                pick = (lang == names[a]) | (lang == names[b])
                found.append(fit_machine(x[pick], np.where(lang[pick] == names[a], 1, -1)))
            self.pair_machines[f] = np.array(found, dtype=np.float32).reshape(len(found), BUCKETS + 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, score = self.families[0], 1.0
        if len(self.families) > 1:
            margins = self.family_machines[:, :-1] @ x + self.family_machines[:, -1]
            best = int(np.argmax(margins))
            family = self.families[best]
            score = _sure(float(margins[best] - np.delete(margins, best).max()) / 2)
        names = self.members[family]
        if len(names) == 1:
            return names[0], score
        margins = self.pair_machines[family][:, :-1] @ x + self.pair_machines[family][:, -1]
        votes = np.zeros((len(names), 2))
        for (a, b), m in zip(self.pairs[family], margins.tolist(), strict=True):
            votes[a if m >= 0 else b, 0] += 1
            votes[[a, b], 1] += (m, -m)
        best = max(range(len(names)), key=lambda k: (votes[k, 0], votes[k, 1]))
        own = [m if a == best else -m for (a, b), m in zip(self.pairs[family], margins.tolist(), strict=True) if best in (a, b)]
        return names[best], score * _sure(min(own))


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * margin)))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, examples: int = EXAMPLES) -> Languages:
    """Fit to the bounded sample of documents (doc_id, text, lang)."""
    known = docs.where("lang is not null and text is not null")
    ids = stored(known.select("lang", "doc_id").distinct(), "labelled")
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sizes.count()
    if not langs:
        return Languages([], [])
    each = min(per_language, max(1, examples // langs))
    # the place of an id's hash among all hashes says whether it is among the smallest
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(2**53))
    chosen = ids.join(sizes, "lang").where(place < F.lit(float(each)) / F.col("n")).select("lang", "doc_id")
    # about `each` rows of each language, `examples` in all
    chosen = F.broadcast(stored(chosen, "chosen"))
    texts = known.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])
    sample = texts.groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def described(rows: Iterator[tuple]) -> Iterator[tuple]:
        for lang, doc_id, text in rows:
            if has_letter(text):
                yield lang, doc_id, packed(counts_of(text))

    rows = map_rows(sample.select("lang", "doc_id", "text"), described, "lang string, doc_id long, x binary").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0))
    x = np.array([scaled(unpacked(r.x)) for r in rows], np.float32).reshape(-1, BUCKETS)
    return Languages(x, [r.lang for r in rows])


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """Adds lang_pred and score to the columns; of these names, they win."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            yield (*row, *model.predict(row[at]))

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_rows(docs.select(*[F.col(f"`{c}`") for c in kept]), run, schema + ", lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents not held out."""
    held_out = (crc_mod("doc_id", 4) == 2).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out)
    model = learn(rows.where("not held_out").select("doc_id", "text", "lang"))
    return identify(rows.select("doc_id", "held_out", whole_text().alias("text")), model).drop("text")
