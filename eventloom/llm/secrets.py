"""Secret scans by grammar inference.

Credentials that plain patterns find are the labelled examples. Their prefix tree is
merged, state by state, wherever two states continue in statistically the same way
(Hoeffding bound on every symbol), which leaves a small probabilistic automaton of the
formats. Every candidate token of a text is then scored by how likely the automaton
writes it; likely ones become spans of their own, beside those of the patterns.

Nulls and empty texts have no spans. Repeated rows give repeated results. An empty table
trains an automaton that accepts nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text

KINDS = ("assign", "access", "hex")
#: Fixed by the contract of the operator; only ASCII letters match in either case.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these is in every text that ASSIGN matches.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: Candidates: runs of the alphabet that labelled values have, as long as the shortest may be.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")

#: At most so many distinct labelled values train the automaton, those of smallest hash.
MAX_EXAMPLES = 1_500
#: Confidence of the merge test and the share of examples that the threshold may miss.
ALPHA, MISSED = 0.05, 0.01

Span = tuple[int, int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end, value) of the patterns' matches, by start, then kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(word in low for word in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


# -- the automaton ------------------------------------------------------------------

#: A symbol is a class of characters; inside a class all characters are alike.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-.")
SYMBOL = {c: k for k, chars in enumerate(CLASSES) for c in chars}
#: Not a class: the end of a value.
END = len(CLASSES)
#: Probability of one character of a class, given the class.
WITHIN = [1 / len(chars) for chars in CLASSES]


class Automaton:
    """States with counts: how often it was visited, how often a value ended there, and
    for each symbol how often it followed and to which state."""

    def __init__(self) -> None:
        self.seen: list[int] = [0]
        self.ends: list[int] = [0]
        self.next: list[dict[int, list[int]]] = [{}]  # symbol -> [count, state]

    def add(self, value: str) -> None:
        state = 0
        self.seen[0] += 1
        for c in value:
            step = self.next[state].get(SYMBOL[c])
            if step is None:
                self.seen.append(0)
                self.ends.append(0)
                self.next.append({})
                step = self.next[state][SYMBOL[c]] = [0, len(self.seen) - 1]
            step[0] += 1
            state = step[1]
            self.seen[state] += 1
        self.ends[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.seen[a], self.seen[b]
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for symbol in self.next[a].keys() | self.next[b].keys():
                fa, ta = self.next[a].get(symbol, (0, -1))
                fb, tb = self.next[b].get(symbol, (0, -1))
                if self._differ(fa, na, fb, nb):
                    return False
                if ta >= 0 and tb >= 0 and ta != tb:
                    todo.append((ta, tb))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to the states below a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for symbol, (count, state) in self.next[b].items():
                mine = self.next[a].get(symbol)
                if mine is None:
                    self.next[a][symbol] = [count, state]
                else:
                    mine[0] += count
                    todo.append((mine[1], state))

    def merge_states(self) -> None:
        """Red states are final; a blue one, next to them, joins the first compatible red
        one or turns red itself."""
        red, position = [0], 0
        known = {0}
        while position < len(red):
            state = red[position]
            for symbol in sorted(self.next[state]):
                count, blue = self.next[state][symbol]
                if blue in known:
                    continue
                for other in red:
                    if self.compatible(other, blue):
                        self.next[state][symbol] = [count, other]
                        self.fold(other, blue)
                        break
                else:
                    red.append(blue)
                    known.add(blue)
            # folding may have added blue states to red ones that are done
            position += 1
            if position == len(red):
                open_states = [s for s in red if any(t not in known for _, t in self.next[s].values())]
                if open_states:
                    position = red.index(open_states[0])

    def frozen(self) -> list[dict[int, tuple[float, int]]]:
        """For each reachable state: symbol -> (log probability of one character, state),
        and under END the log probability that a value ends there."""
        number, order = {0: 0}, [0]
        for state in order:
            for _, target in self.next[state].values():
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
        table = []
        for state in order:
            total = self.seen[state] + len(CLASSES) + 1
            table.append(
                {END: (math.log((self.ends[state] + 1) / total), 0)}
                | {
                    symbol: (
                        math.log((self.next[state].get(symbol, (0, 0))[0] + 1) / total * WITHIN[symbol]),
                        number[self.next[state][symbol][1]] if symbol in self.next[state] else 0,
                    )
                    for symbol in range(len(CLASSES))
                }
            )
        return table


#: What a character, or the end, costs that is drawn evenly from the whole alphabet.
EVEN = math.log(len(SYMBOL) + 1)


def likelihood(table: list[dict[int, tuple[float, int]]], value: str) -> float:
    """Mean log likelihood of the characters and the end, against even draws."""
    state, total = 0, 0.0
    for c in value:
        log_p, state = table[state][SYMBOL[c]]
        total += log_p
    return (total + table[state][END][0]) / (len(value) + 1) + EVEN


class Scorer:
    """The automaton and the score from which a candidate counts as a credential."""

    def __init__(self, examples: Iterable[str]) -> None:
        examples = sorted(set(examples))
        tree = Automaton()
        for value in examples:
            tree.add(value)
        tree.merge_states()
        self.table = tree.frozen()
        scores = sorted(likelihood(self.table, v) for v in examples)
        # never below what an evenly drawn string reaches: the format has to be more likely
        self.threshold = max(0.05, scores[int(MISSED * len(scores))]) if scores else math.inf

    def added_spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Candidates that the automaton finds likely and that no base span touches."""
        out: list[Span] = []
        for m in CANDIDATE.finditer(text):
            value = m[0]
            if any(start < m.end() and m.start() < end for start, _, end, _ in taken):
                continue
            if likelihood(self.table, value) >= self.threshold:
                out.append((m.start(), len(KINDS), m.end(), value))
        return out


# -- on Spark -----------------------------------------------------------------------


def train(docs: DataFrame, max_examples: int = MAX_EXAMPLES) -> Scorer:
    """Labels: the values that the patterns find in all texts. The bounded sample of
    distinct values with the smallest hash goes to the driver."""

    def values(rows: Iterator[tuple]) -> Iterator[tuple]:
        last: dict[str, None] = {}
        for (text,) in rows:
            for _, _, _, value in base_spans(text):
                if value not in last:
                    last[value] = None
                    yield (value,)
            if len(last) > 100_000:
                last.clear()

    found = map_rows(docs.select(whole_text().alias("text")), values, "value string").distinct()
    sample = found.orderBy(F.xxhash64("value"), "value").limit(max_examples).collect()
    return Scorer(r.value for r in sample)


def written(spans: list[Span]) -> str:
    names = (*KINDS, "auto")
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def scan_secrets(docs: DataFrame, scorer: Scorer | None = None, replacement: str | None = None) -> DataFrame:
    """Adds base and all spans of each text (code points, end exclusive) as `base`,
    `spans` and `n_assign`, `n_access`, `n_hex`; with `replacement`, `text` has it in
    place of every span. Other columns stay; of the same names, these win."""
    scorer = scorer or train(docs)
    added = ["n_assign", "n_access", "n_hex", "base", "spans"]
    kept = [c for c in docs.columns if c not in [*added, "text"]]

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, *rest in rows:
            whole = text or ""
            base = base_spans(whole)
            every = sorted(base + scorer.added_spans(whole, base))
            counts = [sum(s[1] == k for s in base) for k in range(3)]
            if replacement is not None and every:
                text = redacted(whole, every, replacement)
            yield (*rest, text, *counts, written(base), written(every))

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    schema += (", " if schema else "") + "text string, n_assign long, n_access long, n_hex long, base string, spans string"
    return map_rows(docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in kept]), scan, schema)


def redacted(text: str, spans: list[Span], replacement: str) -> str:
    out, at = [], 0
    for start, _, end, _ in spans:
        if start < at:  # overlaps the span before
            at = max(at, end)
            continue
        out += [text[at:start], replacement]
        at = end
    return "".join([*out, text[at:]])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    found = scan_secrets(docs.select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )
