"""Byte-pair tokenizers compiled to deterministic transducers.

Two transducers run one after the other over a batch of texts.

* The *splitter* is a small automaton over character classes.  Its transitions
  carry cut marks ("a word starts here" / "a word started one character ago").
  The batch is cut into equal chunks; every chunk is first run from all states
  at once, which gives a state map per chunk; the maps are composed by a
  parallel prefix scan, and a second run from the then known entry states
  writes the cuts.
* The *merge transducer* reads the bytes of a word.  Its states are built when
  first needed: a state holds the part of the word that may still become part
  of a token, with the last token of each prefix that ends there.  A transition
  is annotated with the number of tokens it adds.  All words of a batch advance
  together, one byte a step.

The second automaton rests on a property of byte-pair encoding: a sequence of
tokens is the encoding of its text if and only if each neighbouring pair is the
encoding of its own text, and the encoding of a prefix is settled by the last
token of each shorter prefix.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np

END, LETTER, QUICK, R, V, ELL, E, NUMBER, SPACE, WHITE, OTHER, APOSTROPHE = range(12)
UNKNOWN = 255
CHUNK = 512
#: Code points that one pass takes at once.
BLOCK = 1_000_000
#: States of the merge transducer before it is built anew.
MOST_STATES = 200_000
#: How far back a live prefix ends, its last token and its tokens less those of the whole.
LIVE = struct.Struct("<hih")
#: Pairs of tokens whose fit is remembered.
MOST_FITS = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in vocabulary files, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Cuts class sequences into words.

    join_space: a space belongs to the word after it, and white space makes
    words of its own; else white space only separates.
    single_numbers: each number character is a word.
    """

    def __init__(self, join_space: bool, single_numbers: bool):
        names = ["begin", "letters", "numbers", "others", "space", "spaces", "white", "whites", "quote", "quote_r", "quote_v", "quote_l", "done"]
        at = {n: i for i, n in enumerate(names)}
        self.states = len(names)
        self.next = np.zeros((self.states, 12), np.uint8)
        self.emit = np.zeros((self.states, 12), np.uint8)
        letters = (LETTER, QUICK, R, V, ELL, E)
        fresh = dict.fromkeys(letters, "letters") | {NUMBER: "numbers", SPACE: "space", WHITE: "white", OTHER: "others", APOSTROPHE: "quote", END: "begin"}
        joined = dict.fromkeys(letters, "letters") | {NUMBER: "numbers", OTHER: "others", APOSTROPHE: "others"}
        completes = {"quote_r": E, "quote_v": E, "quote_l": ELL}
        for name in names:
            for c in range(12):
                to, mark = fresh[c], 1
                blank = c in (SPACE, WHITE)
                if c == END:
                    mark = 3 if name in completes else 1
                elif name == "letters" and c in letters:
                    to, mark = "letters", 0
                elif name == "numbers" and c == NUMBER and not single_numbers:
                    to, mark = "numbers", 0
                elif name == "others" and c in (OTHER, APOSTROPHE):
                    to, mark = "others", 0
                elif name == "quote" and c in (QUICK, R, V, ELL, OTHER, APOSTROPHE):
                    to, mark = {QUICK: "done", R: "quote_r", V: "quote_v", ELL: "quote_l"}.get(c, "others"), 0
                elif name in completes:
                    if c == completes[name]:
                        to, mark = "done", 0
                    elif c in letters:
                        to, mark = "letters", 2
                    else:
                        mark = 3
                elif name in ("space", "spaces", "white", "whites"):
                    if blank:
                        to, mark = ("spaces" if c == SPACE else "whites"), 0
                    elif join_space and name in ("space", "spaces"):
                        to, mark = joined[c], 0 if name == "space" else 2
                    elif join_space and name == "whites":
                        mark = 3
                self.next[at[name], c], self.emit[at[name], c] = at[to], mark

    def cuts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a word starts at each place."""
        n = len(classes)
        lanes = -(-n // CHUNK)
        x = np.full(lanes * CHUNK, END, np.uint8)
        x[:n] = classes
        x = np.ascontiguousarray(x.reshape(lanes, CHUNK).T).astype(np.int64)
        step, mark = self.next.ravel(), self.emit.ravel()
        entry = np.zeros(lanes, np.int64)
        if lanes > 1:
            state = np.repeat(np.arange(self.states)[:, None], lanes, 1)
            for j in range(CHUNK):
                state = step[state * 12 + x[j]]
                if len(state) > 1 and j % 8 == 7 and (state == state[0]).all():
                    state = state[:1]
            maps = state if len(state) > 1 else np.repeat(state, self.states, 0)
            reach = 1
            while reach < lanes and len(state) > 1:
                maps = np.concatenate([maps[:, :reach], np.take_along_axis(maps[:, reach:], maps[:, :-reach].astype(np.int64), 0)], 1)
                reach *= 2
            entry[1:] = maps[0, :-1]
        marks = np.empty((CHUNK, lanes), np.uint8)
        for j in range(CHUNK):
            at = entry * 12 + x[j]
            marks[j] = mark[at]
            entry = step[at].astype(np.int64)
        marks = marks.T.ravel()
        cut = (marks[:n] & 1).astype(bool)
        cut[: n - 1] |= (marks[1:n] & 2).astype(bool)
        return cut


class Edges:
    """A map from (state, byte) to (target, tokens added), for arrays of keys: open addressing in plain arrays."""

    def __init__(self, bits: int = 14):
        self.bits, self.used = bits, 0
        self.key = np.full(1 << bits, -1, np.int64)
        self.to, self.adds = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int8)

    def place(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it would go."""
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.key[at]
        off = np.flatnonzero((held != key) & (held >= 0))
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            held = self.key[at[off]]
            off = off[(held != key[off]) & (held >= 0)]
        return at

    def put(self, key: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        """Adds keys that aren't there."""
        if 2 * (self.used + len(key)) > 1 << self.bits:
            old = self.key >= 0
            key, to, adds = (np.concatenate([a[old], b]) for a, b in ((self.key, key), (self.to, to), (self.adds, adds)))
            self.__init__(max(self.bits + 1, int(2 * len(key)).bit_length() + 1))
        self.used += len(key)
        left = np.arange(len(key))
        while len(left):  # of keys that meet in a slot one gets it
            at, first = np.unique(self.place(key[left]), return_index=True)
            now = left[first]
            self.key[at], self.to[at], self.adds[at] = key[now], to[now], adds[now]
            left = np.delete(left, first)


class MergeTransducer:
    """The encoding of single words, as an automaton that grows when used."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.plain: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, number in vocab.items():
            last = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if last else token
            if body and all(c in letters for c in body):
                (self.final if last else self.plain)[bytes(letters[c] for c in body)] = number
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[a], vocab[b]
            self.rank[key] = rank
            self.parts.setdefault(vocab[a + b], (*key, rank))
        self.prefixes = {t[:k] for t in (*self.plain, *self.final) for k in range(1, len(t))}
        self.length = np.zeros(max(vocab.values()) + 1, np.int32)
        for t, number in (*self.plain.items(), *self.final.items()):
            self.length[number] = len(t)
        self.has_final = bool(suffix)
        self.edges: list[dict[int, list[tuple[int, int]]]] = [{}, {}]
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = packed_state(b"", [(0, -1, 0)])
        self.number = {start: 0}
        self.state = [start]
        self.next, self.ends = Edges(), Edges()
        self.last = np.full(4096, -1, np.int32)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts at one edge of a token, each with the rank of the merge that takes it in."""
        found = self.edges[side].get(token)
        if found is None:
            found, part = [(token, 1 << 60)], token
            while part in self.parts:
                up = self.parts[part]
                part = up[side]
                found.append((part, up[2]))
            self.edges[side][token] = found
        return found

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay as they are: no merge across them comes first."""
        key = left, right
        found = self.fits.get(key)
        if found is None:
            found, rank = True, self.rank
            for a, taken in self.edge(left, 1):
                for b, taken_too in self.edge(right, 0):
                    r = rank.get((a, b))
                    if r is not None and r < taken and r <= taken_too:
                        found = False
                        break
                if not found:
                    break
            if len(self.fits) > MOST_FITS:
                self.fits.clear()
            self.fits[key] = found
        return found

    def token_after(self, window: bytes, live: list, byte: int, vocab: dict[bytes, int]) -> tuple[bytes, int, int]:
        longer = window + bytes((byte,))
        n = len(window)
        for back, last, count in live:
            token = vocab.get(longer[n - back :])
            if token is not None and (last < 0 or self.fit(last, token)):
                return longer, token, count + 1
        raise ValueError(f"no token for the bytes {longer!r}")

    def build(self, key: int) -> tuple[int, int]:
        state, byte = key >> 8, key & 255
        window, old = unpacked_state(self.state[state])
        longer, token, adds = self.token_after(window, old, byte, self.plain)
        n, prefixes = len(window), self.prefixes
        live = [(back + 1, last, count - adds) for back, last, count in old if longer[n - back :] in prefixes]
        live.append((0, token, 0))
        name = packed_state(longer[len(longer) - live[0][0] :], live)
        to = self.number.get(name)
        if to is None:
            to = self.number[name] = len(self.state)
            self.state.append(name)
            if to >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last), -1, np.int32)])
            self.last[to] = token
        return to, adds

    def build_end(self, key: int) -> tuple[int, int]:
        window, live = unpacked_state(self.state[key >> 8])
        _, token, adds = self.token_after(window, live, key & 255, self.final)
        return token, adds

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of each word, and with want_ids their numbers one after the other.

        Past MOST_STATES the states are dropped and grow anew, so memory stays bounded whatever the text.
        """
        if len(self.state) > MOST_STATES:
            self.reset()
        order = np.argsort(-lengths, kind="stable")
        start, length = starts[order], lengths[order]
        n = len(order)
        state, count = np.zeros(n, np.int64), np.zeros(n, np.int32)
        token_at = np.full(len(data), -1, np.int32) if want_ids else None
        alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if n else 1), side="right")
        for j, k in enumerate(alive.tolist()):
            at = start[:k] + j
            key = state[:k] * 256 + data[at]
            if self.has_final:  # the words that end here
                first = int(np.searchsorted(-length[:k], -(j + 1), side="left"))
                if first < k:
                    token, adds = self.look(self.ends, key[first:], self.build_end)
                    count[first:k] += adds
                    if want_ids:
                        token_at[at[first:]] = token
                k = first
                if not k:
                    continue
            to, adds = self.look(self.next, key[:k], self.build)
            count[:k] += adds
            state[:k] = to
            if want_ids:
                token_at[at[:k]] = self.last[to]
        counts = np.empty(n, np.int64)
        counts[order] = count
        if not want_ids:
            return counts, None
        ids = np.empty(int(counts.sum()), np.uint32)
        place, at, live = np.cumsum(counts) - 1, starts + lengths - 1, np.arange(n)
        while len(live):
            token = token_at[at]
            ids[place] = token
            at, place = at - self.length[token], place - 1
            stay = at >= starts[live]
            live, at, place = live[stay], at[stay], place[stay]
        return counts, ids

    @staticmethod
    def look(edges: Edges, key: np.ndarray, build) -> tuple[np.ndarray, np.ndarray]:
        """Targets and added tokens; transitions that aren't there yet are built."""
        at = edges.place(key)
        missing = edges.key[at] < 0
        if missing.any():
            new = np.unique(key[missing])
            made = np.array([build(k) for k in new.tolist()], np.int64)
            edges.put(new, made[:, 0].astype(np.int32), made[:, 1].astype(np.int8))
            at = edges.place(key)
        return edges.to[at], edges.adds[at]


def packed_state(window: bytes, live: list[tuple[int, int, int]]) -> bytes:
    return bytes((len(live),)) + b"".join(LIVE.pack(*x) for x in live) + window


def unpacked_state(state: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    end = 1 + state[0] * LIVE.size
    return state[end:], list(LIVE.iter_unpack(state[1:end]))


class Tokenizer:
    """Counts and ids as the library gives them for a byte-level BPE file, special strings in texts included."""

    def __init__(self, path: str):
        import tokenizers

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.words = MergeTransducer(model["vocab"], model["merges"], suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # of those that start at a place the longest counts
        self.find_special = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        kinds = [n["type"] for n in ((spec.get("normalizer") or {}).get("normalizers") or [])]
        self.normal = "Lowercase" in kinds
        self.join_space = not self.normal
        self.splitter = Splitter(self.join_space, single_numbers=self.normal)
        # the library's vocabulary isn't kept: only its splitter is asked, for the class of a character
        self.library = tokenizers.Tokenizer.from_file(path).pre_tokenizer
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def learn_class(self, point: int) -> None:
        """Asks the library's own splitter what a character counts as."""
        c = chr(point)

        def pieces(t):
            return [x for x, _ in self.library.pre_tokenize_str(t)]

        if c == "'":
            kind = APOSTROPHE
        elif c == " ":
            kind = SPACE
        elif len(pieces(f"a{c}a")) == 1 and len(pieces(c)) == 1:
            kind = {"s": QUICK, "t": QUICK, "m": QUICK, "d": QUICK, "r": R, "v": V, "l": ELL, "e": E}.get(c, LETTER)
        elif len(pieces(f"!{c}!")) == 1:
            kind = OTHER
        elif self.join_space:
            kind = NUMBER if len(pieces(f"1{c}1")) == 1 else WHITE
        else:
            kind = NUMBER if pieces(c) else WHITE
        self.classes[point] = kind

    def segments(self, text: str):
        """The parts of a text between special strings: (part, the special string's id after it or -1)."""
        at = 0
        for found in self.find_special.finditer(text) if self.special else ():
            yield text[at : found.start()], self.special[found[0]]
            at = found.end()
        rest = text[at:]
        start = 0
        while len(rest) - start > BLOCK:  # cut where a word starts whatever came before: at white space after something else
            cut = next((k for k in range(start + BLOCK // 2, len(rest)) if rest[k] in " \n" and rest[k - 1] not in " \n\t\r\x0b\x0c\x85" and not rest[k - 1].isspace()), 0)
            if not cut:
                break
            yield rest[start:cut], -1
            start = cut
        yield rest[start:], -1

    def clean(self, part: str) -> str:
        if not self.normal or not part:
            return part
        if not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        return part.replace("Σ", "σ").lower()

    def encode(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray, list[np.ndarray] | None]:
        """Tokens of each text, and with want_ids the ids of each."""
        counts, ids = np.zeros(len(texts), np.int64), [[] for _ in texts] if want_ids else None
        parts, owner, after, size = [], [], [], 0
        for i, text in enumerate(texts):
            for part, special in self.segments(text):
                if size and size + len(part) > BLOCK:
                    self.flush(parts, owner, after, counts, ids)
                    parts, owner, after, size = [], [], [], 0
                parts.append(self.clean(part))
                owner.append(i)
                after.append(special)
                size += len(part) + 1
        if parts:
            self.flush(parts, owner, after, counts, ids)
        if ids is not None:
            ids = [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.uint32) for x in ids]
        return counts, ids

    def flush(self, parts, owner, after, counts, ids) -> None:
        text = "\0".join(parts) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        seams = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        kind = self.classes[points]
        if (kind == UNKNOWN).any():
            for p in np.unique(points[kind == UNKNOWN]).tolist():
                self.learn_class(p)
            kind = self.classes[points]
        kind[seams] = END
        starts = np.flatnonzero(self.splitter.cuts(kind))
        ends = np.append(starts[1:], len(points))
        keep = kind[starts] != END
        if not self.join_space:
            keep &= (kind[starts] != WHITE) & (kind[starts] != SPACE)
        starts, ends = starts[keep], ends[keep]
        offset = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        first = offset[starts]
        n, numbers = self.words.run(data, first, offset[ends] - first, ids is not None)
        part = np.searchsorted(seams, starts)
        per_part = np.bincount(part, weights=n, minlength=len(parts)).astype(np.int64)
        counts += np.bincount(owner, weights=per_part + (np.asarray(after) >= 0), minlength=len(counts)).astype(np.int64)
        if ids is not None:
            edge = np.concatenate([[0], np.cumsum(per_part)])
            for k, (i, special) in enumerate(zip(owner, after, strict=True)):
                if per_part[k]:
                    ids[i].append(numbers[edge[k] : edge[k + 1]])
                if special >= 0:
                    ids[i].append(np.array([special], np.uint32))


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """The compiled tokenizer of a file, kept as long as the worker lives."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]
