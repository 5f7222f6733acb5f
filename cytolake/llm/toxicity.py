"""Toxicity scoring with noisy-channel deobfuscation.

A token that looks disguised (digits or signs among its letters, letters kept apart by
separators or spaces, a letter three times or more in a row) becomes a lattice: each
place may be what stands there, a letter that it may stand for, or, within a repetition
or between letters, nothing.  A Viterbi decoder picks the path with the best sum of the channel's costs and the
probability of its letters under a character trigram model, which is counted over all
documents.  A sign that is kept is a symbol of its own, so that it is no word's edge.  Two
of a kind are mostly a true double letter, and so left out at a higher cost than in a longer
run; a word with doubles is scored without them too.  Tokens of any length are decoded.  Other tokens have one path, themselves.
Letters set apart are then split into words by a second Viterbi pass, under the
frequencies of words in the training documents.

Each restored word, and a run of letters set apart also as one word, is scored by how much likelier they are in toxic documents: log odds of
document counts, for the word and for its beginnings, learned from all labelled
documents that aren't held out.  The strongest words and their number make a document's evidence, and a
logistic regression on it its score; for the fit, a document's evidence comes from the
other folds.  Counts and the regression's sums are added up in the cluster; the features that speak for toxic
and the words that occur often enough come to the driver.

Defined cases: a null or empty text has no words and the score of no evidence; without
labels of both kinds every score is the share of ones (0 without labels); repeated rows
and null ids pass through row by row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.common import arrow_map, arrow_schema, columns, documents, held_out, staged, texts
from cytolake.llm.labelled import labelled_documents, labels_of

FOLDS, THRESHOLD, REMEMBERED = 5, 0.3, 600_000
#: Features that a task counts before it hands their counts on.
COUNTED = 300_000

#: Letters of the character model: those of Latin scripts by number, 0 for all else (and for a word's edges).
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
_NUMBER = {c: i for i, c in enumerate(_LETTERS, 1)}
SYMBOLS = len(_LETTERS) + 1
#: What a sign may stand for in a disguised word.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "¡": "i",
}
#: What stands for no letter of the model, where it is kept.
MARK = SYMBOLS
#: Channel costs (natural logarithms): a sign for a letter, a letter left out of a run of three or more, of two, a separator left out, a sign kept.
SIGN, REPEAT, DOUBLE, APART, KEPT = -1.0, -0.5, -12.0, -0.3, -20.0
#: Share of any letter alike in a probability, as disguised words may have letters together that no document has.
ANY = 0.01

_SPACED = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")
_APART = re.compile(r"\w(?:[._\-*~]\w){2,}")
_STRIP = ".,;:!?\"'()[]{}<>|#$%&*-_=/~`^+“”‘’«»…"
_ADDRESS = re.compile(r"\w@\w+\.\w|://|^www\.|\w=\w")
_SIGNS = re.compile("[" + re.escape("".join(STANDS_FOR)) + "]")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_DOUBLES = re.compile(r"(.)\1+")


class CharacterModel:
    """Log probabilities of a letter after two others, and of words (if there are any, letters set apart are split into words)."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pair = n.sum(axis=0)
        one = (pair.sum(axis=0) + 1) / (pair.sum() + SYMBOLS)
        two = (pair + 20 * one) / (pair.sum(axis=1, keepdims=True) + 20)
        # After a kept sign, which has a cost of its own, letters have the probabilities that they have anywhere.
        self.log = np.zeros((SYMBOLS + 1,) * 3)
        self.log[:-1, :-1, :-1] = (n + 20 * two[None]) / (n.sum(axis=2, keepdims=True) + 20)
        self.log[-1, :-1, :-1] = two
        self.log[:, -1, :-1] = one
        self.log[..., :-1] = np.log((1 - ANY) * self.log[..., :-1] + ANY / SYMBOLS)
        self.words: dict[str, float] = {}
        self.longest, self.unknown = 0, 0.0

    def learn_words(self, counts: dict[str, int]) -> None:
        """Take over how often words occur."""
        total = sum(counts.values()) or 1
        self.words = {w: float(np.log(n / total)) for w, n in counts.items()}
        self.longest, self.unknown = max(map(len, counts), default=0), -float(np.log(total))


_CODE = np.zeros(0x180, np.int64)
for _c, _i in _NUMBER.items():
    _CODE[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x180:
        _CODE[ord(_c.upper())] = _i


def trigrams(batch: list[str]) -> np.ndarray:
    """Counts of letter trigrams of some texts; what isn't a letter is one edge symbol."""
    points = np.frombuffer("  ".join(["", *batch, ""]).encode("utf-32-le"), np.uint32)
    code = _CODE[np.where(points < 0x180, points, 0)].astype(np.int32)
    code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]  # a run of edges is one
    if code.size < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    return np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=SYMBOLS**3)


def character_model(df: DataFrame) -> CharacterModel:
    """The model of all documents' texts. Counts are added up in the cluster; one for each trigram that occurs
    (at most ``SYMBOLS**3``) comes to the driver."""
    ddl = "trigram int, n bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            total += trigrams(texts(b.column(0)))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], schema=schema)

    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in arrow_map(columns(df, text="string"), run, ddl, rows=300).groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[r.trigram] = r.n
    return CharacterModel(counts)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each place of a token, what it may be and at which cost; an empty string: nothing."""
    apart, n = set_apart(token), len(token)
    for i, c in enumerate(token):
        if apart and i % 2:
            yield [("", APART)]
            continue
        ways = [(c, 0.0)] if c in _NUMBER else [(c, KEPT)] + [(x, SIGN) for x in STANDS_FOR.get(c, "")]
        if i and token[i - 1] == c:
            longer = i > 1 and token[i - 2] == c or i + 1 < n and token[i + 1] == c
            ways.append(("", REPEAT if longer else DOUBLE))
        yield ways


def decode(token: str, model: CharacterModel) -> str:
    """The best path through a token's lattice under the channel and the character model (Viterbi), linear in its length."""
    log, number = model.log, _NUMBER.get
    # A state's path is its last letters and the path before them. Where all paths meet in one state, it is settled.
    settled: list[str] = []
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ways in lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (value, path) in states.items():
            for c, cost in ways:
                if c:
                    k = number(c, MARK)
                    state, v = (b, k), value + cost + log[a, b, k]
                else:
                    state, v = (a, b), value + cost
                if state not in after or v > after[state][0]:
                    after[state] = (v, (path, c) if c else path)
        states = after
        if len(states) == 1:
            ((state, (value, path)),) = states.items()
            settled.append(_along(path))
            states = {state: (value, None)}
    return "".join(settled) + max((v + log[a, b, 0], _along(path)) for (a, b), (v, path) in states.items())[1]


def _along(path: tuple | None) -> str:
    """The letters of a path."""
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


#: Cost of each letter of a word that isn't known, as much as one of 26 letters.
UNKNOWN = -float(np.log(26))


def split_words(letters: str, model: CharacterModel) -> list[str]:
    """The most likely words that a run of letters is made of (Viterbi), linear in its length."""
    words, n = model.words, len(letters)
    best, inside = [0.0] * (n + 1), -np.inf  # the best split that ends here; the best whose last word is unknown
    start, opened = [0] * (n + 1), 0
    for i in range(1, n + 1):
        if best[i - 1] + model.unknown > inside:
            inside, opened = best[i - 1] + model.unknown, i - 1
        inside += UNKNOWN
        top, at = inside, opened
        for j in range(max(0, i - model.longest), i):
            w = words.get(letters[j:i])
            if w is not None and best[j] + w > top:
                top, at = best[j] + w, j
        best[i], start[i] = top, at
    out = []
    while n:
        out.append(letters[start[n]:n])
        n = start[n]
    return out[::-1]


def set_apart(token: str) -> bool:
    """Whether a token is letters that separators or spaces set apart."""
    return bool(_APART.fullmatch(token)) or " " in token


def restored(token: str, model: CharacterModel) -> str:
    """The word that a token stands for, in lower case; the words, by spaces, if letters set apart are several."""
    word = token.lower()
    if word.isalpha() and not _REPEATED.search(word):
        return word
    core = word.strip(_STRIP)
    if core.isalpha() and not _REPEATED.search(core):
        # Signs at the edges are punctuation, or letters in disguise ("$cum"); the latter only if next to letters alone.
        if core == word or len(word) - len(core) > 2 or not any(c in STANDS_FOR and c not in "!*#|" for c in word.replace(core, "", 1)):
            return core
        core = word.strip(".,;:?\"'-")
    if not any(c.isalpha() for c in core) or _ADDRESS.search(core):
        return core
    if not (_SIGNS.search(core) or _REPEATED.search(core) or _APART.fullmatch(core) or " " in core):
        return core
    word = decode(core, model)
    return " ".join(split_words(word, model)) if model.words and set_apart(core) else word


def readings(token: str, model: CharacterModel) -> list[str]:
    """What a token may stand for: with the signs at its end as punctuation, and as letters; letters set apart, as one
    word too; a disguised word with doubles, without them too."""
    word = restored(token, model)
    if " " in word:
        return [word, word.replace(" ", "")]
    out = [word]
    if token[-1] in "$@" and _SIGNS.search(token[:-1].rstrip("$@")):
        out.append(decode(token.lower().strip(".,;:?!\"'-()[]{}"), model))
    if word not in token.lower():
        out += [x for x in (_DOUBLES.sub(r"\1", w) for w in list(out)) if x not in out]
    return out


def tokens(text: str) -> list[str]:
    """The tokens of a text; letters set apart by spaces are one."""
    if _SPACED.search(text):
        spaced = _SPACED.findall(text)
        return _SPACED.sub(" ", text).split() + spaced
    return text.split()


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word] + [f"{word[:k]}~" for k in (3, 4, 5, 6) if len(word) > k]


def words_of(reading: str) -> list[str]:
    """The words of what a token stands for."""
    return reading.split() or [reading]


#: Documents, toxic ones among them, with a feature before it counts; log odds below which it doesn't.
LEAST_DOCS, LEAST_WEIGHT = 3, 1.5


def weights(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log odds of features, from the numbers of toxic and clean documents with them; only those that speak for toxic."""
    out = {}
    for f, (t, c) in counts.items():
        if t >= LEAST_DOCS:
            w = float(np.log((t + 0.1) / (toxic + 0.2)) - np.log((c + 0.5) / (clean + 1)))
            if w >= LEAST_WEIGHT:
                out[f] = w
    return out


class Scorer:
    """Evidence and score of texts; remembers the weights of recent tokens."""

    def __init__(self, model: CharacterModel, weight: dict[str, float], coefficients: np.ndarray | None = None, constant: float | None = None):
        self.model, self.weight, self.coefficients, self.constant = model, weight, coefficients, constant
        self.known: dict[str, float] = {}
        self.further: dict[str, list[float]] = {}  # of a token that is several words, all but the strongest

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "further": {}}

    def token(self, token: str) -> float:
        get = self.weight.get
        first, *others = readings(token, self.model)
        each = [max(get(f, 0.0) for f in features(word)) for word in words_of(first)]
        if len(each) > 1:
            each.sort()
            self.further[token] = each[:-1]
        w = self.known[token] = max(each[-1], *[get(f, 0.0) for word in others for f in features(word)], 0.0)
        return w

    def weighed(self, got: list[str]) -> list[float]:
        """The weights of tokens, then those of the further words of tokens that are several."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.further.clear()
        found = list(map(self.known.get, got))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            w = self.known.get(got[at])
            found[at] = self.token(got[at]) if w is None else w
        if self.further:
            for t in got:
                if t in self.further:
                    found += self.further[t]
        return found

    def evidence(self, text: str) -> np.ndarray:
        """The strongest word, the mean of the three strongest, how many speak for toxic, and their share."""
        found = self.weighed(tokens(text))
        return summary(found, len(found))

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.evidence(text) @ self.coefficients[:-1] + self.coefficients[-1], -30, 30))))


def summary(found: list[float], n: int) -> np.ndarray:
    """The evidence of a text of ``n`` words whose weights, those of 0 or not, are found."""
    strong = sorted(filter(None, found), reverse=True)
    if not strong:
        return np.zeros(4)
    top = strong[:3]
    return np.array([top[0], sum(top) / 3, np.log1p(len(strong)), len(strong) / (n + 5) * 10])


def evidence_like(text: str, most: Scorer, own: Scorer) -> np.ndarray:
    """The evidence of a text by ``own``, no weight of which is over that of ``most``: only tokens that have one there are weighed anew."""
    got = tokens(text)
    found = most.weighed(got)
    return summary(own.weighed([t for t, w in zip(got, found) if w]), len(found))


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last of the ``n`` coefficients is the intercept, which isn't shrunk.

    ``sums`` gives the log likelihood's second derivatives, with a plus, and gradient at some coefficients.
    """
    w, penalty = np.zeros(n), np.diag([ridge] * (n - 1) + [1e-6])
    for _ in range(40):
        second, gradient = sums(w)
        step = np.linalg.solve(second + penalty, gradient - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def likelihood(x: np.ndarray, y: np.ndarray, times: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums for :func:`newton` of rows that count so many times."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return (x * (times * p * (1 - p))[:, None]).T @ x, x.T @ (times * (y - p))


def logistic(rows: DataFrame, width: int) -> np.ndarray:
    """The regression of ``y`` on ``e`` (of ``width`` numbers) of rows that count ``n`` times: a few sums of each task come to the driver."""
    n, ddl = width + 1, "sums array<double>"
    schema = arrow_schema(ddl)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            total = np.zeros((n, n + 1))
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy().reshape(-1, width)
                    second, gradient = likelihood(x, b.column(1).to_numpy(), b.column(2).to_numpy(), w)
                    total += np.hstack([second, gradient[:, None]])
            yield pa.record_batch([pa.array([total.ravel().tolist()], schema.field(0).type)], schema=schema)

        got = np.sum([r.sums for r in arrow_map(rows.select("e", "y", "n"), run, ddl, rows=10_000).collect()], axis=0).reshape(n, n + 1)
        return got[:, :-1], got[:, -1]

    return newton(sums, n)


class _Numbers(dict):
    """Features and their numbers; that of "", which is in all documents, is 0."""

    def __missing__(self, feature: str) -> int:
        n = self[feature] = len(self)
        return n


class _Tokens(dict):
    """Tokens and the numbers of their words' features, remembered."""

    def __init__(self, model: CharacterModel, numbers: _Numbers):
        self.model, self.numbers = model, numbers

    def __missing__(self, token: str) -> tuple[int, ...]:
        got = self[token] = tuple({self.numbers[f] for word in words_of(restored(token, self.model)) for f in features(word)})
        return got


#: For each fold, the toxic and the clean documents.
_COUNTS = [f"{c}{k}" for k in range(FOLDS) for c in ("toxic", "clean")]


def feature_counts(labelled: DataFrame, model: CharacterModel) -> DataFrame:
    """``feature`` and in how many toxic and clean documents of each fold it is; the feature "" is in all. One row for each that is in
    ``LEAST_DOCS`` toxic documents, and for each word in as many of any kind."""
    held = labelled.sparkSession.sparkContext.broadcast(model)
    ddl = "feature string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    schema = arrow_schema(ddl)

    def run(batches):
        numbers = _Numbers({"": 0})
        known, total = _Tokens(held.value, numbers), np.zeros((1, 2 * FOLDS), np.int64)

        def counted():
            seen = np.flatnonzero(total.any(axis=1))
            names = list(numbers)
            return pa.record_batch([pa.array([names[i] for i in seen], pa.string()), *(pa.array(total[seen, k]) for k in range(2 * FOLDS))], schema=schema)

        for b in batches:
            cells = []
            for d, t, y in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist()):
                own = {0}.union(*map(known.__getitem__, set(tokens(t))))
                cells.append(np.fromiter(own, np.int64, len(own)) * (2 * FOLDS) + (d % FOLDS * 2 + 1 - y))
            if cells:
                total = np.vstack([total, np.zeros((len(numbers) - len(total), 2 * FOLDS), np.int64)])
                total += np.bincount(np.concatenate(cells), minlength=total.size).reshape(total.shape)
            if len(numbers) > COUNTED:
                yield counted()
                known.clear()
                numbers.clear()
                numbers[""] = 0
                total = np.zeros((1, 2 * FOLDS), np.int64)
        yield counted()

    total = arrow_map(labelled.select("doc_id", "text", "label"), run, ddl).groupBy("feature").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    toxic, all_ = (sum((F.col(c) for c in _COUNTS if c.startswith(kind)), F.lit(0)) for kind in ("toxic", ""))
    # And words, for the splitting of letters set apart.
    return total.where((toxic >= LEAST_DOCS) | ~F.col("feature").endswith("~") & (all_ >= LEAST_DOCS) | (F.col("feature") == ""))


def speaking(counts: DataFrame, documents_: np.ndarray) -> DataFrame:
    """The rows of :func:`feature_counts` that may speak for toxic in all documents or in those without one fold."""
    some = F.lit(False)
    for without in (None, *range(FOLDS)):
        t, c = (sum((F.col(f"{kind}{k}") for k in range(FOLDS) if k != without), F.lit(0)) for kind in ("toxic", "clean"))
        toxic, clean = documents_[[k for k in range(FOLDS) if k != without]].sum(axis=0).tolist()
        odds = F.log((t + 0.1) / (toxic + 0.2)) - F.log((c + 0.5) / (clean + 1.0))
        some |= (t >= LEAST_DOCS) & (odds >= LEAST_WEIGHT - 1e-6)  # weights() decides
    return counts.where(some & (F.col("feature") != ""))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Character model, word weights and regression, from all documents and all labels that aren't held out."""
    model = character_model(docs)
    labelled = staged(labelled_documents(docs, labels, "toxic"), "labelled")
    counts = staged(feature_counts(labelled, model), "features")
    documents_ = np.array([r[1:] for r in counts.where("feature = ''").collect()], int).reshape(-1, FOLDS, 2).sum(axis=0)
    words = counts.where("feature <> '' and not endswith(feature, '~')").select("feature", sum((F.col(c) for c in _COUNTS), F.lit(0)).alias("n")).toArrow()
    model.learn_words({f: n for f, n in zip(*(c.to_pylist() for c in words.columns)) if f.isalpha()})
    if not documents_.sum(axis=0).all():
        return Scorer(model, {}, constant=1.0 if documents_[:, 0].any() else 0.0)
    got = {r.feature: np.array(r[1:]).reshape(FOLDS, 2) for r in speaking(counts, documents_).collect()}

    def weight(without: int | None) -> dict[str, float]:
        keep = [k for k in range(FOLDS) if k != without]
        return weights({f: tuple(n[keep].sum(axis=0)) for f, n in got.items()}, *documents_[keep].sum(axis=0))

    by_fold, whole = [weight(k) for k in range(FOLDS)], weight(None)
    most = {f: max(w.get(f, 0.0) for w in by_fold) for f in set().union(*by_fold)}
    spread = docs.sparkSession.sparkContext.broadcast((model, most, by_fold))
    ddl = "y int, e array<double>"
    schema = arrow_schema(ddl)

    def evidence(batches):
        model, most, by_fold = spread.value
        some, scorers = Scorer(model, most), [Scorer(model, w) for w in by_fold]
        for b in batches:
            e = [evidence_like(t, some, scorers[d % FOLDS]).tolist() for d, t in zip(b.column(0).to_pylist(), texts(b.column(1)))]
            yield pa.record_batch([b.column(2), pa.array(e, schema.field(1).type)], schema=schema)

    seen = arrow_map(labelled.select("doc_id", "text", "label"), evidence, ddl)
    seen = staged(seen.groupBy("e", "y").agg(F.count("*").cast("double").alias("n")), "evidence")  # most have none: one row
    return Scorer(model, whole, logistic(seen.withColumn("y", F.col("y").cast("double")), 4))


_SCORERS: dict = {}
SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def score_toxicity(df: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    held, schema, key = df.sparkSession.sparkContext.broadcast(scorer), arrow_schema(SCORED), uuid.uuid4().hex

    def run(batches):
        gc.disable()
        if _SCORERS.get("of") != key:  # a worker keeps what it remembers from task to task
            _SCORERS.update(of=key, scorer=held.value)
        scorer = _SCORERS["scorer"]
        for b in batches:
            s = np.array([scorer.score(t) for t in texts(b.column(1))], float)
            yield pa.record_batch([b.column(0), pa.array([held_out(d) for d in b.column(0).to_pylist()]), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return arrow_map(columns(df, doc_id="bigint", text="string"), run, SCORED, rows=300)


def restore(df: DataFrame, model: CharacterModel) -> DataFrame:
    """``doc_id, text, restored``: the texts with every token restored."""
    ddl = "doc_id bigint, text string, restored string"
    schema = arrow_schema(ddl)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            out = [" ".join(restored(x, held.value) for x in tokens(t)) for t in texts(b.column(1))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], schema=schema)

    return arrow_map(columns(df, doc_id="bigint", text="string"), run, ddl)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train(docs, labels_of(spark, sf_dir)))
