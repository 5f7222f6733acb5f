"""BPE encoding and decoding with a memory-mapped minimal acyclic transducer.

The corpus' frequent words (pre-tokens) are compiled, with the token ids they encode
to, into a minimal acyclic automaton that shares prefixes and suffixes.  Every arc
carries a number; their sum along an accepted word is the word's index, which leads to
its ids.  The automaton is one file of flat arrays, written once in each executor's own
work folder and memory-mapped by its workers.  Words that it doesn't accept are merged
pair by pair, exactly.  The lexicon decides only the speed: results are the same with
any lexicon, the empty one included.

Defined cases: a null text is an empty one and has no ids; a special token's string in
a text is that token, as the tokenizers library has it; repeated rows and null ids pass
through row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.common import arrow_map, arrow_schema, columns, documents, texts

#: Words in the lexicon at most, and the share of a task's words from which a word is counted.
LEXICON, LEAST_SHARE = 50_000, 2e-6
#: Words that a worker remembers.
REMEMBERED = 600_000
#: Texts of these characters are split by a plain pattern; others by the library, whose Unicode tables Python's don't equal.
_LETTER, _SPACE = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "\t-\r "
_PLAIN = re.compile(f"[{_SPACE}!-~{_LETTER}]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}0-9{_LETTER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


#: No pair of these can be merged.
NEVER = 1 << 40


class Merger:
    """Merges the bytes of words pair by pair: always the pair that comes first in the merges' list, the leftmost of equal ones."""

    def __init__(self, vocab: dict[str, int], merges: list, alphabet: list[str], whole_first: bool = False):
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        self.size = max(vocab.values(), default=0) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order  # of a pair that is listed twice, the last place counts
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte = np.array([vocab[c] for c in alphabet], np.int64)
        self._lists = self.byte.tolist(), self.made.tolist(), dict(zip(self.key.tolist(), self.rank.tolist())), self.size
        back = {c: i for i, c in enumerate(alphabet)}
        self.whole = {bytes(back[c] for c in t): i for t, i in vocab.items() if all(c in back for c in t)} if whole_first else {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The places of pairs in the list, ``NEVER`` for one that isn't in it or has no second part."""
        if not self.key.size:
            return np.full(left.shape, NEVER)
        key = left * self.size + right
        at = np.searchsorted(self.key, key, side="right") - 1
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NEVER)

    def merged(self, words: list[bytes], together: int = 64, few: int = 200) -> list[list[int]]:
        """The ids of some words; if many are of about one length, these take each step together, others are merged by a heap."""
        out: list = [None] * len(words)
        lots: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.whole:
                out[i] = [self.whole[w]]
            elif len(w) > together:
                out[i] = self.merged_alone(w)
            else:
                lots.setdefault((len(w) + 3) // 4, []).append(i)
        for fours, lot in lots.items():
            if len(lot) < few:
                for i in lot:
                    out[i] = self.merged_alone(words[i])
                continue
            for at in range(0, len(lot), 4096):
                own = lot[at:at + 4096]
                for i, ids in zip(own, self._lot([words[i] for i in own], max(1, 4 * fours))):
                    out[i] = ids
        return out

    def _lot(self, words: list[bytes], width: int) -> list[list[int]]:
        chars = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        place, length = np.arange(width), np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), width + 1), -1)
        ids[:, :width] = np.where(place < length[:, None], self.byte[chars], -1)
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        active, done = np.arange(len(words)), ids.copy()
        place = np.arange(width + 1)
        while active.size:
            j = rank.argmin(axis=1)
            row = np.arange(active.size)
            best = rank[row, j]
            more = best < NEVER
            if not more.all():
                done[active[~more]] = ids[~more]
                active, ids, rank, j, best = active[more], ids[more], rank[more], j[more], best[more]
                row = np.arange(active.size)
                if not active.size:
                    break
            ids[row, j] = self.made[best]
            after = np.minimum(place + (place > j[:, None]), width)  # without the second part
            ids = np.take_along_axis(ids, after, axis=1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(after[:, :-1], width - 1), axis=1)
            rank[:, -1] = NEVER
            rank[row, j] = self.ranks(ids[row, j], ids[row, np.minimum(j + 1, width)])
            before = np.flatnonzero(j > 0)
            rank[before, j[before] - 1] = self.ranks(ids[before, j[before] - 1], ids[before, j[before]])
        return [r[:n].tolist() for r, n in zip(done, (done >= 0).sum(axis=1).tolist())]

    def merged_alone(self, word: bytes) -> list[int]:
        """The ids of one word of any length, in time that its length times its logarithm bounds."""
        byte, made, place, size = self._lists
        own, n = [byte[c] for c in word], len(word)
        now = [place.get(own[i] * size + own[i + 1], NEVER) for i in range(n - 1)] + [NEVER]  # of the pair that begins here
        heap = [(r, i) for i, r in enumerate(now) if r < NEVER]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            own[i], own[j], now[j] = made[r], -1, NEVER
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = place.get(own[i] * size + own[k], NEVER)
                if now[i] < NEVER:
                    heapq.heappush(heap, (now[i], i))
            else:
                now[i] = NEVER
            h = before[i]
            if h >= 0:
                now[h] = place.get(own[h] * size + own[i], NEVER)
                if now[h] < NEVER:
                    heapq.heappush(heap, (now[h], h))
        return [x for x in own if x >= 0]


class Bpe:
    """Exact byte-level BPE from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: i for i, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.pre = library.pre_tokenizer
        self.merger = Merger(vocab, spec["model"]["merges"], alphabet, bool(spec["model"].get("ignore_merges")))

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return _WORDS.findall(text)
        return [text[i:j] for _, (i, j) in self.pre.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token's string is one of its own."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.words(text)
        return [x for part in self.split_special.split(text) for x in ([part] if part in self.special else self.words(part))]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file of a minimal acyclic transducer of the words, by the incremental construction from sorted words.

    Arrays (little-endian): for each state its first arc, acceptance and number of accepted continuations are
    folded into arcs sorted by ``state * 256 + byte``; an arc has its target and the number of words that
    come before those through it, so that the sum along a word is its place among the sorted words.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[dict[int, int]] = []
    final: list[bool] = []

    def new() -> int:
        states.append({})
        final.append(False)
        return len(states) - 1

    root = new()
    path = [(root, -1)]  # states of the word before, unregistered, and the byte that led there
    for k, word in enumerate([*words, None]):
        before = words[k - 1] if k else b""
        common = 0
        if word is not None:
            while common < min(len(word), len(before)) and word[common] == before[common]:
                common += 1
        while len(path) - 1 > common:  # minimise what can no longer change
            state, byte = path.pop()
            key = (final[state], tuple(sorted(states[state].items())))
            same = register.setdefault(key, state)
            if same != state:
                states[path[-1][0]][byte] = same
        if word is not None:
            for byte in word[common:]:
                state = new()
                states[path[-1][0]][byte] = state
                path.append((state, byte))
            final[path[-1][0]] = True
    # Number the reachable states and count the words from each.
    order, number = [], {root: 0}
    todo = [root]
    while todo:
        s = todo.pop()
        order.append(s)
        for t in states[s].values():
            if t not in number:
                number[t] = len(number)
                todo.append(t)
    count: dict[int, int] = {}

    def counted(top: int) -> None:
        pile = [top]
        while pile:
            s = pile[-1]
            missing = [t for t in states[s].values() if t not in count]
            if missing:
                pile += missing
            else:
                count[s] = final[s] + sum(count[t] for t in states[s].values())
                pile.pop()

    counted(root)
    keys, targets, outputs = [], [], []
    accept = np.zeros(len(number), np.uint8)
    for s in order:
        accept[number[s]] = final[s]
        skipped = int(final[s])
        for byte, t in sorted(states[s].items()):
            keys.append(number[s] * 256 + byte)
            targets.append(number[t])
            outputs.append(skipped)
            skipped += count[t]
    by = np.argsort(np.array(keys, np.uint64)) if keys else np.zeros(0, np.int64)
    ids = [entries[w] for w in words]
    parts = [
        np.array(keys, np.uint64)[by], np.array(targets, np.uint32)[by], np.array(outputs, np.uint32)[by],
        accept, np.cumsum([0, *map(len, ids)], dtype=np.uint32), np.array([i for x in ids for i in x], np.uint32),
    ]
    head = np.array([p.nbytes for p in parts], np.int64).tobytes()
    return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, data: bytes | mmap.mmap):
        sizes = np.frombuffer(data, np.int64, 6)
        at, parts = 48, []
        for size, kind in zip(sizes, (np.uint64, np.uint32, np.uint32, np.uint8, np.uint32, np.uint32)):
            parts.append(np.frombuffer(data, kind, int(size) // np.dtype(kind).itemsize, at))
            at += int(size) + int(-size % 8)
        self.keys, self.targets, self.outputs, self.accept, self.starts, self.ids = parts

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Write the file once in this machine's own work folder, named by its digest, and map it read-only."""
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}")
        if not os.path.exists(path):
            with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as f:
                f.write(data)
            os.replace(f.name, path)
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, or None; all words take each step through the automaton together."""
        n = len(words)
        if not n or not self.keys.size:
            return [None] * n
        length = np.fromiter(map(len, words), np.int64, n)
        chars = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        state, index = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        alive, step = np.flatnonzero(length > 0), 0
        ok = np.zeros(n, bool)
        while alive.size:
            key = state[alive] * np.uint64(256) + chars[begin[alive] + step]
            arc = np.searchsorted(self.keys, key)
            arc[arc == self.keys.size] = 0
            good = self.keys[arc] == key
            alive, arc = alive[good], arc[good]
            state[alive] = self.targets[arc]
            index[alive] += self.outputs[arc]
            step += 1
            ended = length[alive] == step
            done = alive[ended]
            ok[done] = self.accept[state[done].astype(np.int64)] == 1
            alive = alive[~ended]
        return [self.ids[self.starts[i]:self.starts[i + 1]].tolist() if y else None for i, y in zip(index.tolist(), ok.tolist())]


def frequent_words(df: DataFrame, path: str, size: int = LEXICON, least_share: float = LEAST_SHARE) -> list[str]:
    """The pre-tokens with most occurrences, over all texts; ``size`` of them come to the driver at most.

    A word with a share of ``least_share`` of all words has that share in some task, so a task passes on
    only those; a task's table is passed on and emptied when it has grown large.
    """
    schema = arrow_schema("word string, n bigint")

    def count(batches):
        seen: Counter = Counter()
        bpe = Bpe(path)

        def out():
            least = max(2, least_share * seen.total())
            rows = [(w, n) for w, n in seen.items() if n >= least]
            seen.clear()
            return pa.record_batch([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], schema=schema)

        for b in batches:
            for t in texts(b.column(0)):
                seen.update(bpe.words(t))
            if len(seen) > 1_000_000:
                yield out()
        if seen:
            yield out()

    counted = arrow_map(df.select("text"), count, "word string, n bigint")
    got = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in got.collect()]


def build_lexicon(df: DataFrame, path: str, size: int = LEXICON) -> bytes:
    """The compiled lexicon of the corpus' frequent words."""
    bpe = Bpe(path)
    words = [w.encode() for w in frequent_words(df, path, size)]
    return compile_lexicon(dict(zip(words, bpe.merger.merged(words))))


class Encoder:
    """Encodes texts with a lexicon and exact merging; remembers recent words."""

    def __init__(self, path: str, lexicon: bytes, remembered: int = REMEMBERED):
        self.bpe, self.lexicon, self.remembered = Bpe(path), Lexicon.mapped(lexicon), remembered
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't remembered: those of the lexicon by its automaton, the others by merging."""
        decode, ids, raw = self.bpe.decode_bytes, self.ids, self.raw
        split = [w.encode() for w in words]
        found = self.lexicon.find(split)
        rest = [i for i, own in enumerate(found) if own is None]
        for i, own in zip(rest, self.bpe.merger.merged([split[i] for i in rest])):
            found[i] = own
        for w, own in zip(words, found):
            ids[w] = ",".join(map(str, own))
            raw[w] = decode(own)

    def encode(self, batch: list[str]) -> list[tuple[str, int, bytes]]:
        """For each text its ids as decimal numbers joined by commas, their number, and the bytes they decode to."""
        if len(self.ids) > self.remembered:
            self.ids.clear()
            self.raw.clear()
        for s, i in self.bpe.special.items():
            self.ids[s], self.raw[s] = str(i), self.bpe.bytes[i]
        get = self.ids.get
        split = [self.bpe.pieces(t) for t in batch]
        found = [list(map(get, words)) for words in split]
        late = [i for i, got in enumerate(found) if None in got]
        if late:
            self.learn(list({w for i in late for w, got in zip(split[i], found[i]) if got is None}))
            for i in late:
                got, words, at = found[i], split[i], -1
                for _ in range(got.count(None)):
                    at = got.index(None, at + 1)
                    got[at] = get(words[at])
        joined = [",".join(got) for got in found]
        return [(s, s.count(",") + 1 if s else 0, b"".join(map(self.raw.__getitem__, words))) for s, words in zip(joined, split)]


_ENCODERS: dict = {}
ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _mapped(df: DataFrame, path: str, lexicon: bytes, ddl: str, arrays):
    held, schema = df.sparkSession.sparkContext.broadcast(lexicon), arrow_schema(ddl)

    digest = hashlib.sha256(lexicon).hexdigest()

    def run(batches):
        gc.disable()  # nothing here makes cycles, and walking large tables is dear
        if _ENCODERS.get("of") != (path, digest):  # a worker keeps its encoder, with what it remembers, from task to task
            _ENCODERS.update(of=(path, digest), encoder=Encoder(path, held.value))
        encoder = _ENCODERS["encoder"]
        for b in batches:
            yield pa.record_batch([b.column(0), *arrays(encoder.encode(texts(b.column(1))))], schema=schema)

    return arrow_map(columns(df, doc_id="bigint", text="string"), run, ddl, rows=200)


def encode(df: DataFrame, path: str, lexicon: bytes) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every text: encoded with the tokenizer file at ``path`` and decoded again."""
    return _mapped(df, path, lexicon, ENCODED, lambda got: [
        pa.array([n for _, n, _ in got], pa.int64()), pa.array([np.fromstring(s, np.int32, sep=",") if s else [] for s, _, _ in got], pa.list_(pa.int32())),
        pa.array([d.decode("utf-8", "replace") for _, _, d in got], pa.string())])


def encode_digests(df: DataFrame, path: str, lexicon: bytes) -> DataFrame:
    """The same as digests, without handing the ids to Spark."""
    return _mapped(df, path, lexicon, DIGEST, lambda got: [
        pa.array([n for _, n, _ in got], pa.int64()), pa.array([hashlib.sha256(s.encode()).hexdigest() for s, _, _ in got]),
        pa.array([hashlib.sha256(d.decode("utf-8", "replace").encode()).hexdigest() for _, _, d in got])])


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, docs = public_tokenizers.path("byte_bpe_50k.json"), documents(spark, sf_dir)
    return encode_digests(docs, path, build_lexicon(docs, path))
