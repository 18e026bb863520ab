"""Toxic documents, found in text that is restored from disguise first."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosieve.llm.common import materialize, read_table, text_column, text_slices

#: Labelled rows that the word weights are fitted on at most (a seeded hash sample if there are more).
MAX_LABELLED = 20_000
#: A word, or the first letters of words, tell of toxicity if they are this many times as frequent in toxic texts as in others,
#: in this many times as large a share of the texts,
RATIO, TEXT_RATIO = 10.0, 3.0
#: and if they stand between this many different pairs of words there. So many words may come out by chance alone.
MIN_CONTEXTS, BY_CHANCE = 3, 0.1
STEM_LENGTHS = (4, 5, 6)
#: Letters of the shortest word that is looked for.
SHORTEST = 3
#: A word is sure, and decides alone, if this share of the texts that hold it is toxic, and half of all such texts with this
#: confidence; of others it takes this many.
SURE, CONFIDENCE, MIN_HITS = 0.98, 0.99, 2
#: From this chance on a document is toxic: on held-out labels a chance below a half finds more toxic texts, and hardly more others.
THRESHOLD = 0.3

ORDER, BASE = 4, 32
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)} | {c: 27 for c in "äàâáãå"} | {c: 28 for c in "éèêë"} | {c: 29 for c in "öóòôõ"} | {c: 30 for c in "üúùûíìîï"}
_OTHER = 31
#: What a disguised letter may stand for, with the cost of the disguise (a negative log probability).
CHANNEL = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou",
}
_DISGUISE, _DROP, _SHORTEN, _MASK, _WORD = 1.0, 1.5, 1.0, 3.3, 6.0
_MASKS = "*#%&"
_LOOKALIKES = str.maketrans("οоеасрхуіѕԁαεικνρτυ", "ooeacpxyisdaeiknptu")
_MARKS = ".,;:?\"'`()[]{}<>«»“”„…-–—_=/\\~^"
_SIGNS = "!@#$%&*+|"
_DOUBLE = re.compile(r"(.)\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]|[0-9@$!|+*])(?:[ .\-_*]+(?:[^\W\d_]|[0-9@$!|+*])){2,}(?!\S)")


def _code_table() -> np.ndarray:
    table = np.zeros(0x250, np.int32)
    for i in range(0x250):
        c = chr(i)
        if c.isalpha():
            table[i] = _CODE.get(c.lower(), _OTHER)
    return table


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the four-letter grams of the texts; everything but letters is one border sign."""
    raw = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(raw < 0x250, _code_table()[np.minimum(raw, 0x24F)], np.where(raw < 0x2000, np.int32(_OTHER), np.int32(0)))
    code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
    code = np.concatenate([np.zeros(2, np.int32), code]) if len(code) else np.zeros(4, np.int32)
    key = ((code[:-3] * BASE + code[1:-2]) * BASE + code[2:-1]) * BASE + code[3:]
    n = np.bincount(key, minlength=0)
    at = np.flatnonzero(n)
    return at, n[at]


def letter_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Negative log probabilities of a letter after three others, from counts over all documents.

    The table has 32 to the power of 4 entries whatever the corpus holds.
    """
    src = docs.select(docs[text_col].alias("t")).filter(F.col("t").isNotNull())

    def run(batches):
        total = np.zeros(BASE**ORDER, np.int64)
        for batch in batches:
            for part in text_slices(batch, "t", 1_000_000):
                at, n = gram_counts(text_column(part, "t"))
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])

    counts = np.zeros(BASE**ORDER, np.float64)
    rows = src.mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    counts[rows.column("g").to_numpy()] = rows.column("n").to_numpy()
    return smooth(counts)


def smooth(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell interpolation of the orders from four down to one."""
    p = np.full(BASE, 1.0 / BASE)
    for order in range(1, ORDER + 1):
        c = counts.reshape(-1, BASE**order).sum(0).reshape(-1, BASE)
        kinds, total = (c > 0).sum(1, keepdims=True), c.sum(1, keepdims=True)
        low = np.tile(p.reshape(-1, BASE), (max(1, len(c) // max(1, p.size // BASE)), 1))[: len(c)]
        p = (c + kinds * low) / np.maximum(1, total + kinds)
        p = np.where(total > 0, p, low)
    return (-np.log(np.maximum(p, 1e-12))).astype(np.float32).ravel()


class Restorer:
    """Viterbi decoding of disguised words, as letters under the letter model or as a word that is looked for.

    A word that is looked for costs ``_WORD`` besides its disguise, however long it is; its letters cost nothing. Readings
    matter only where they may be such a word or begin with one of the ``stems``, so only then are letters decoded.
    """

    def __init__(self, costs: np.ndarray, words: list[str], stems: list[str] = ()):
        self.costs, self.known = costs, {}
        self.words, self.stems = frozenset(w for w in words if len(w) >= SHORTEST), frozenset(stems)
        self.heads = frozenset(w[:k] for w in (*self.words, *self.stems) for k in range(len(w) + 1))
        self.next: dict[str, list[str]] = defaultdict(list)
        for h in self.heads:
            if h:
                self.next[h[:-1]].append(h)

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each place, the letters that it may stand for and their costs; '' drops it, '?' is any letter."""
        out, i = [], 0
        while i < len(token):
            c = token[i]
            j = i
            while j < len(token) and token[j] == c:
                j += 1
            if c.isalpha():
                one = [(c, 0.0)]
            elif c in CHANNEL:
                one = [(x, _DISGUISE) for x in CHANNEL[c]] + [("", _DROP)] + ([("?", _MASK)] if c in _MASKS else [])
            else:
                one = [("", 0.0)]
            if j - i >= 3:
                out.append(one)
                out.append([(x, p) for x, p in one if x] + [("", _SHORTEN)])
            elif j - i == 2:
                out += [one, [*one, ("", _SHORTEN)]]
            else:
                out.append(one)
            i = j
        return out

    def decode(self, token: str) -> str:
        """The likeliest reading of a word in lower case; '' if no reading can be a word or begin with a stem that is looked for."""
        word = self.known.get(token)
        if word is None:
            if len(self.known) > 50_000:
                self.known.clear()
            places = self.lattice(token)
            cost_known, known, stem = self._known(places)
            word = ""
            if known or stem:
                cost, word = self._letters(places)
                if known and cost_known + _WORD <= cost:
                    word = known
            self.known[token] = word
        return word

    def letters(self, run: str) -> str:
        """The likeliest letters of a run, such as letters that stand apart: what stands between them is dropped."""
        return self._letters(self.lattice(run))[1]

    def _letters(self, places: list[list[tuple[str, float]]]) -> tuple[float, str]:
        costs, mask = self.costs, BASE**3
        at: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for place in places:
            new: dict[int, tuple[float, tuple | None]] = {}
            for context, (cost, word) in at.items():
                for letter, price in place:
                    if letter == "?":
                        continue
                    if letter:
                        key = context * BASE + _CODE.get(letter, _OTHER)
                        total = cost + price + float(costs[key])
                        key %= mask
                    else:
                        total, key = cost + price, context
                    old = new.get(key)
                    if old is None or total < old[0]:
                        new[key] = (total, (word, letter) if letter else word)
            at = new
        cost, word = min(((cost + float(costs[context * BASE]), word) for context, (cost, word) in at.items()), key=lambda x: x[0])
        out = []
        while word:
            word, letter = word
            out.append(letter)
        return cost, "".join(reversed(out))

    def _known(self, places: list[list[tuple[str, float]]]) -> tuple[float, str, bool]:
        """The cheapest word that is looked for, and whether some reading begins with a stem."""
        at, stem = {"": 0.0}, False
        for place in places:
            new: dict[str, float] = {}
            for head, cost in at.items():
                for letter, price in place:
                    heads = self.next.get(head, ()) if letter == "?" else (head + letter,) if letter else (head,)
                    for h in heads:
                        if h in self.heads and cost + price < new.get(h, 1e9):
                            new[h] = cost + price
            at = new
            if not at:
                return 1e9, "", stem
            stem = stem or not self.stems.isdisjoint(at)
        return (*min(((cost, head) for head, cost in at.items() if head in self.words), default=(1e9, "")), stem)

    def lookalike(self, word: str) -> str:
        """A word that is looked for, written with letters that look like its own; '' if there is none."""
        plain = "".join(c for c in unicodedata.normalize("NFKD", word.translate(_LOOKALIKES)) if not unicodedata.combining(c))
        return plain if plain in self.words else ""


def _core(token: str) -> str:
    """A token without plain marks and runs of signs at its ends."""
    a, b = 0, len(token)
    while True:
        before = a, b
        while a < b and token[a] in _MARKS:
            a += 1
        while a < b and token[b - 1] in _MARKS:
            b -= 1
        if b - a > 1 and token[a] in _SIGNS and token[a] == token[a + 1]:
            sign = token[a]
            while a < b and token[a] == sign:
                a += 1
        if b - a > 1 and token[b - 1] in _SIGNS and token[b - 1] == token[b - 2]:
            sign = token[b - 1]
            while a < b and token[b - 1] == sign:
                b -= 1
        if (a, b) == before:
            return token[a:b]


class TokenReader(dict):
    """The words that a token may be: itself, and its restored readings if it looks disguised. Let go when it has grown large."""

    def __init__(self, restorer: Restorer | None):
        super().__init__()
        self.restorer = restorer

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 100_000:
            self.clear()
        self[token] = words = self.read(token)
        return words

    def read(self, token: str) -> tuple[str, ...]:
        low = token.lower()
        if low.isalpha() and not _DOUBLE.search(low):
            if low.isascii():
                return (low,)
            words = (low,)
        else:
            core = _core(low)
            if core.isalpha() and not _DOUBLE.search(core):
                words = (core,)
            elif not any(c.isalpha() or c in CHANNEL for c in core):
                words = ()
            else:
                parts = tuple(p for p in re.split(r"[^\w@$!|+*#%&€£]+", core) if p.isalpha())
                whole = low.strip(_MARKS).rstrip("!").strip(_MARKS)
                words = (*parts, *(self.restorer.decode(x) for x in dict.fromkeys((core.rstrip("!"), core, whole)))) if self.restorer else parts
        if self.restorer and words and not words[0].isascii():
            words = (*words, self.restorer.lookalike(words[0]))
        return tuple(dict.fromkeys(w for w in words if w))


def _variants(words: tuple[str, ...]):
    """The words and their first letters, written with a ``*`` after them."""
    for w in words:
        yield w
        for k in STEM_LENGTHS:
            if len(w) > k:
                yield w[:k] + "*"


def _counts(batches):
    """For words and first letters: how many texts hold them, how often, and hashes of the pairs of words that they stand between."""
    reader, n, often, between = TokenReader(None), Counter(), Counter(), defaultdict(set)
    for batch in batches:
        for text in text_column(batch, "t"):
            rows = [w for w in map(reader.__getitem__, text.split()) if w]
            found = Counter()
            for k, words in enumerate(rows):
                pair = (rows[k - 1][-1] if k else "") + " " + (rows[k + 1][0] if k + 1 < len(rows) else "")
                place = xxhash.xxh32_intdigest(pair.encode("utf-8", "surrogatepass")) >> 1
                for w in _variants(words):
                    found[w] += 1
                    between[w].add(place)
            n.update(found.keys())
            often.update(found)
    words = list(n)
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (n, often)), pa.array([sorted(between[w]) for w in words], pa.list_(pa.int32()))], ["w", "n", "often", "between"])


@dataclass
class Evidence:
    """What was learned from labelled texts: chances of sure words, all telling words and first letters, the share of such words
    in a toxic text that has some and in all other texts, and the share of toxic texts."""

    sure: dict[str, float] = field(default_factory=dict)
    telling: frozenset = frozenset()
    toxic_rate: float = 0.02
    clean_rate: float = 0.0002
    share: float = 0.1
    #: The classifier's weights of ``features_of``, its constant last; none where there was nothing to fit it on.
    weights: tuple[float, ...] = ()

    def words(self) -> list[str]:
        return [w for w in {*self.sure, *self.telling} if w[-1] != "*"]

    def stems(self) -> list[str]:
        return [w[:-1] for w in self.telling if w[-1] == "*"]


def evidence_of(n: int, other: int, share: float) -> float:
    """The log of the likelihood ratio that a word in n toxic and other clean texts is toxic more often than the share of all.

    By Chernoff's bound a word that tells nothing comes to x with a chance of exp(-x) at most.
    """
    p = n / (n + other)
    return 0.0 if p <= share else n * math.log(p / share) + (other * math.log((1 - p) / (1 - share)) if other else 0.0)


def is_sure(n: int, other: int) -> bool:
    """Whether a word in n toxic and other clean texts decides alone: were half of such texts toxic, so many would hardly be."""
    total = n + other
    tail = sum(math.exp(math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) - total * math.log(2)) for k in range(other + 1))
    return n >= SURE * total and tail <= 1 - CONFIDENCE


def fit_words(rows: DataFrame) -> Evidence:
    """Learns from labelled texts (t, y); equal ones count once, and near copies as often as they differ around a word.

    Each word is tested by its own counts, against the chance that any of all words that were counted passes.
    The executors count; the driver gets the words that may tell. Without toxic texts nothing tells.
    """
    rows = materialize(rows.filter("t IS NOT NULL").dropDuplicates(["t", "y"]), "toxicity-labelled")
    size = F.size(F.split(F.trim("t"), "\\s+"))
    totals = {r["y"]: (r["n"], r["tokens"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("tokens")).collect()}
    (n_toxic, toxic_tokens), (n_clean, clean_tokens) = totals.get(1, (0, 0)), totals.get(0, (0, 0))
    if not n_toxic:
        return Evidence()
    spread = rows.filter("y = 1").select("t").mapInArrow(_counts, "w string, n bigint, often bigint, between array<int>")
    seen = spread.groupBy("w").agg(F.sum("n").alias("n"), F.sum("often").alias("often"), F.size(F.array_distinct(F.flatten(F.collect_list("between")))).alias("kinds"))
    seen = materialize(seen.select("w", F.least("n", "kinds").alias("n"), "often").filter((F.length("w") > 2) & (F.col("n") >= MIN_CONTEXTS)), "toxicity-words")
    share = n_toxic / (n_toxic + max(1, n_clean))
    least = math.log(max(1, seen.count()) / BY_CHANCE)
    may = {r["w"]: (r["n"], r["often"]) for r in seen.filter(F.col("n") * -math.log(share) >= least).collect()}
    asked = rows.sparkSession.sparkContext.broadcast(frozenset(may))

    def clean_counts(batches):
        reader, n, often, wanted = TokenReader(None), Counter(), Counter(), asked.value
        for batch in batches:
            for text in text_column(batch, "t"):
                found = Counter()
                for token, k in Counter(text.split()).items():
                    for w in _variants(reader[token]):
                        if w in wanted:
                            found[w] += k
                n.update(found.keys())
                often.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([often[w] for w in n], pa.int64())], ["w", "n", "often"])

    counted = rows.filter("y = 0").select("t").mapInArrow(clean_counts, "w string, n bigint, often bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("often").alias("often"))
    clean = {r["w"]: (r["n"], r["often"]) for r in counted.collect()}
    out = Evidence(share=min(0.9, n_toxic / (n_toxic + n_clean)))
    for w, (n, often) in may.items():
        other, other_often = clean.get(w, (0, 0))
        if evidence_of(n, other, share) >= least and often / toxic_tokens >= RATIO * (other_often + 0.5) / max(1, clean_tokens) and n / n_toxic >= TEXT_RATIO * (other + 0.5) / max(1, n_clean):
            out.telling |= {w}
            if w[-1] != "*" and is_sure(n, other):
                out.sure[w] = n / (n + other + 1.0)
    told = rows.sparkSession.sparkContext.broadcast(out)

    def hits(batches):
        scorer, n, rates = TokenScorer(TokenReader(None), told.value), Counter(), []
        for batch in batches:
            for t, y in zip(text_column(batch, "t"), batch.column(1).to_pylist()):
                tokens = t.split()
                k = sum(c for token, c in Counter(tokens).items() if scorer[token] is not None)
                if y and k:
                    rates.append(k / len(tokens))
                elif not y:
                    n["clean"] += k
        yield pa.RecordBatch.from_arrays([pa.array([n["clean"]], pa.int64()), pa.array([len(rates)], pa.int64()), pa.array([sum(rates)], pa.float64())], ["clean", "n", "rates"])

    got = rows.select("t", "y").mapInArrow(hits, "clean bigint, n bigint, rates double").agg(F.sum("clean").alias("clean"), F.sum("n").alias("n"), F.sum("rates").alias("rates")).first()
    if got["n"]:
        out.toxic_rate = got["rates"] / got["n"]
    out.clean_rate = min(out.toxic_rate / RATIO, (got["clean"] + 1) / (clean_tokens + 1))
    if n_clean:
        measured = rows.sparkSession.sparkContext.broadcast(out)

        def features(batches):
            scorer = TokenScorer(TokenReader(None), measured.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([features_of(t, scorer) for t in text_column(batch, "t")], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

        seen = rows.select("t", F.col("y").cast("int").alias("y")).mapInArrow(features, "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).toArrow()
        x, y, n = np.array(seen.column("x").to_pylist(), np.float64), seen.column("y").to_numpy(), seen.column("n").to_numpy()
        out.weights = tuple(fit_logistic(x, y, n).tolist())
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton's method; rows count n times."""
    a = np.column_stack([x, np.ones(len(x))])
    w, hold = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    hold[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + hold, a.T @ (n * (y - p)) - hold @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class TokenScorer(dict):
    """The sure word in a token's readings ('' if it is only telling), None for others. Let go when it has grown large."""

    def __init__(self, reader: TokenReader, evidence: Evidence):
        super().__init__()
        self.reader, self.evidence = reader, evidence
        self.spaced = [w for w in evidence.words() if len(w) >= SHORTEST]
        self.stems = [frozenset(w for w in evidence.stems() if len(w) == k) for k in STEM_LENGTHS]

    def __missing__(self, token: str) -> str | None:
        if len(self) > 150_000:
            self.clear()
        found, sure, telling = None, self.evidence.sure, self.evidence.telling
        four, five, six = self.stems
        for w in self.reader.read(token):
            if w in sure:
                found = w
                break
            if w in telling or (len(w) > 4 and (w[:4] in four or (w[:5] in five and len(w) > 5) or (w[:6] in six and len(w) > 6))):
                found = ""
        self[token] = found
        return found


def worst_stretch(places: list[int], gain: float, cost: float) -> tuple[float, int, int]:
    """The most that a stretch of tokens from one hit to another comes to, at a gain for each hit and a cost for each token; its hits and its tokens.

    A stretch has MIN_HITS hits at least; there is none, at -inf, if there are fewer.
    """
    best, start, first_hit, found = -math.inf, -math.inf, 0, (0, 0)
    for k, place in enumerate(places):
        first = k - MIN_HITS + 1
        if first >= 0:
            begin = places[first] * cost - first * gain
            if begin > start:
                start, first_hit = begin, first
            value = start + (k + 1) * gain - (place + 1) * cost
            if value > best:
                best, found = value, (k - first_hit + 1, place - places[first_hit] + 1)
    return best, *found


def worst_window(places: list[int], gain: float, cost: float) -> float:
    return worst_stretch(places, gain, cost)[0]


def findings(text: str, scorer: TokenScorer) -> tuple[list[int], set[str]]:
    """The places of telling tokens in a restored text, in order, and the sure words in it."""
    e, sure, tokens = scorer.evidence, set(), text.split()
    told = {token: found for token in set(tokens) if (found := scorer[token]) is not None}
    sure.update(found for found in told.values() if found)
    places = [i for i, token in enumerate(tokens) if token in told] if told else []
    if scorer.reader.restorer:
        at = done = 0
        for m in _SPACED.finditer(text):
            at, done = at + len(text[done : m.start()].split()), m.start()
            joined = scorer.reader.restorer.letters(m.group(0).lower())
            found = [w for w in scorer.spaced if w == joined or (len(w) > 3 and w in joined)]
            if found:
                places.append(at)
            sure.update(w for w in found if w in e.sure)
    return sorted(places), sure


def _worst(places: list[int], e: Evidence) -> tuple[float, int, int]:
    odds, hits, size = worst_stretch(places, math.log(e.toxic_rate / e.clean_rate), e.toxic_rate - e.clean_rate)
    return odds + math.log(e.share / (1 - e.share)), hits, size


def _features(places: list[int], sure: set[str], e: Evidence) -> list[float]:
    odds, hits, size = _worst(places, e)
    certain = -sum(math.log(1 - e.sure[w]) for w in sure)
    return [max(-10.0, min(10.0, odds)), min(10.0, certain), math.log1p(hits), math.log1p(100 * hits / max(1, size)), float(bool(places))]


def features_of(text: str, scorer: TokenScorer) -> list[float]:
    """What the classifier sees of a whole restored text: its worst stretch's odds, hits and density, and its sure words.

    None of them falls with the text's length.
    """
    return _features(*findings(text, scorer), scorer.evidence)


def score(text: str, scorer: TokenScorer) -> float:
    """The chance that a text is toxic, from all its tokens with their restored readings, and from letters that stand apart.

    Of telling words, as many must come in some stretch of the text as toxic texts of that length have rather than others:
    the two counts are taken as Poisson, and the worst stretch counts, so that a passage weighs the same alone and inside a
    long text. A logistic regression that was fitted on the labelled texts weighs that together with sure words; without
    one, sure words decide alone, and else the worst stretch.
    """
    e = scorer.evidence
    places, sure = findings(text, scorer)
    if e.weights:
        if not places:
            return 0.0
        z = sum(a * b for a, b in zip(_features(places, sure, e), e.weights)) + e.weights[-1]
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
    rest = 1.0
    for w in sure:
        rest *= 1 - e.sure[w]
    if len(places) < MIN_HITS:
        return 1 - rest
    return max(1 - rest, 1 / (1 + math.exp(-max(-700.0, min(700.0, _worst(places, e)[0])))))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Texts with labels (t, y), of ``limit`` labelled rows at most: those of the smallest seeded hashes of their ids. They are broadcast, as ``limit`` bounds them."""
    rows = labels.filter("toxic IS NOT NULL").select(labels["doc_id"].alias("i"), (F.col("toxic").cast("int") != 0).cast("int").alias("y")).distinct()
    rows = rows.orderBy(F.xxhash64(F.lit(5), "i"), "i", "y").limit(limit)
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).filter(F.col("t").isNotNull()).join(F.broadcast(rows), "i").select("t", "y")


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, and toxicity (0 to 1) and is_toxic.

    The letter model counts all documents; words and the classifier come from at most ``max_labelled`` labelled ones. Tokens
    that hold digits or signs for letters, doubled letters, or letters that stand apart are read as lattices and decoded; a
    word with doubled letters may be itself too; other tokens have one reading. Texts of any length are read whole. A null,
    empty or wordless text has toxicity 0; without toxic labels every text has. A chance that equals the threshold is toxic;
    of readings that cost the same, the first one counts. Repeated rows get the same result, labels that repeat or have no
    value count once or not at all. An empty table gives no rows. Columns named toxicity or is_toxic are replaced, others
    are kept whatever their names.
    """
    docs = docs.drop("toxicity", "is_toxic")
    evidence = fit_words(labelled(docs, labels, id_col, text_col, max_labelled))
    tables = docs.sparkSession.sparkContext.broadcast((letter_model(docs, text_col), evidence))
    names = docs.columns
    t = names.index(text_col)
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches):
        costs, told = tables.value
        scorer = TokenScorer(TokenReader(Restorer(costs, told.words(), told.stems())), told)
        for batch in batches:
            for part in text_slices(batch, f"c{t}", 4_000_000):
                s = [0.0 if x is None else score(x, scorer) for x in text_column(part, f"c{t}")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array([x >= threshold for x in s], pa.bool_())], [*part.schema.names, "toxicity", "is_toxic"])

    kinds = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    out = src.mapInArrow(run, T.StructType([*kinds, T.StructField("toxicity", T.DoubleType()), T.StructField("is_toxic", T.BooleanType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "toxicity", "is_toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "toxicity", "is_toxic")
