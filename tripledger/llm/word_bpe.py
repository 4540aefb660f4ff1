"""Word-level BPE by speculation: greedy tokens, vectorised checks of adjacent pairs, exact merging where a check fails.

A token sequence is the BPE encoding of its word exactly if every token encodes to itself and every two
neighbours would also stand side by side if they were a word of their own. So a greedy longest-match
proposal needs only pair checks, which run on numpy arrays over all new words of a batch at once.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from struct import pack

import numpy as np
import regex

# The letters, digits and white space of the vocabulary's own split pattern.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS_OR_DIGITS = regex.compile(r"[\p{L}\p{N}]")
ALL_CHARACTERS = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def _pieces(early: str = "") -> regex.Pattern:
    """The vocabulary's split pattern. early: letters and digits of newer Unicode versions, which stay symbols."""
    but, more = (f"--[{regex.escape(early)}]", f"|[{regex.escape(early)}]") if early else ("", "")
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}{but}]+|[\p{{N}}{but}]|(?:[^{SPACE}\p{{L}}\p{{N}}]{more})+")


USUAL_PIECES = _pieces()


@lru_cache(maxsize=1)
def _careful_pieces() -> tuple[frozenset[str], regex.Pattern]:
    early = [c for c in LETTERS_OR_DIGITS.findall(ALL_CHARACTERS) if unicodedata.category(c) == "Cn"]
    return frozenset(early), _pieces("".join(early))


def split_chunk(chunk: str) -> list[str]:
    """The words that the split pattern finds in a text without white space."""
    if chunk.isalpha():
        return [chunk]
    if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    if chunk.isascii() or max(chunk) < "\u0250":
        return USUAL_PIECES.findall(chunk)
    early, careful = _careful_pieces()
    return (USUAL_PIECES if early.isdisjoint(chunk) else careful).findall(chunk)


NOT_SPACE = regex.compile(rf"[^{SPACE}]+")
ODD_SPLITS = regex.compile(r"[\x1c-\x1f]")

WORD_END = "</w>"
CACHED_WORDS = 400_000
LEARNED_TOGETHER = 20_000
#: Characters of texts that are split and looked up together.
ENCODED_TOGETHER = 2_000_000
_BETWEEN = b"\xff"  # no byte of UTF-8
_LETTER, _STOP, _GAP = (np.isin(np.arange(256), list(x)) for x in (bytes(range(97, 123)), b",.;:!?", b" \t\n\x0b\x0c\r" + _BETWEEN))


def _apart(raw: bytes) -> bytes:
    """raw with a blank between a letter and the stop that ends its word, so that the word is looked up without it.

    Only single stops between an ASCII letter and white space: longer runs of symbols are one word of their own.
    """
    x = np.frombuffer(raw, np.uint8)
    if len(x) < 2:
        return raw
    found = _STOP[x]
    found[0] = False
    found[1:] &= _LETTER[x[:-1]]
    found[:-1] &= _GAP[x[1:]]
    at = np.flatnonzero(found)
    out = np.full(len(x) + len(at), 32, np.uint8)
    stay = np.ones(len(out), bool)
    stay[at + np.arange(len(at))] = False
    out[stay] = x
    return out.tobytes()


_NO_MERGE = 1 << 40
_END = 256  # the symbol after a word's last byte


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else 256 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class IntTable:
    """A fixed hash table from non-negative integers to integers that answers whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self._bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self._bits
        self._mask, self._missing = size - 1, missing
        self._keys, self._values = np.full(size, -1, np.int64), np.full(size, missing, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self._keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self._keys[slot[put]], self._values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Multiplication spreads the keys; a taken slot passes them to the next."""
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._values[slot], self._missing)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            found = self._keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class WordBpe:
    """Encoder and decoder of one vocabulary file (BPE over lower-cased words with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.strings: dict[int, str] = {i: s for s, i in vocab.items()}
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.specials.items()}
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        size = max(self.strings) + 1
        self.token_text = [self.strings.get(i, "") for i in range(size)]

        as_byte = _byte_letters()
        self.inner: dict[bytes, int] = {}  # tokens inside a word
        self.final: dict[bytes, int] = {}  # tokens that end one
        is_final = np.zeros(size, bool)
        merged = {a + b for a, b in merges}
        for s, i in vocab.items():
            if s not in merged:
                is_final[i] = s.endswith(WORD_END)
        self.left, self.right = np.arange(size), np.arange(size)
        keys, values = [], []
        for a, b in merges:
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            is_final[z] = is_final[y]
            self.left[z], self.right[z] = x, y
            keys.append(x << 20 | y)
            values.append(z)
        self._merges = IntTable(np.array(keys), np.array(values), _NO_MERGE)
        self._sound = self._sound_tokens(np.array(values))
        # a token that its own letters do not encode to is in no encoding, so no proposal has it
        self._build_trie(
            {i: ([as_byte[c] for c in s[: -len(WORD_END)]] + [_END]) if is_final[i] else [as_byte[c] for c in s] for s, i in vocab.items() if self._sound[i]}
        )
        self._cache: dict[bytes, bytes] = {}
        self.proposed = self.remerged = 0

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Token that each pair merges to, or a number beyond all tokens."""
        return self._merges.get(left << 20 | right)

    def compatible(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of each pair comes before the merges that built its tokens.

        Undoes the newer side's last merge step by step; across the border, only a merge older than the
        one just undone could have happened first. before: consider only merges older than this.
        """
        left, right = left.astype(np.int64), right.astype(np.int64)
        limit = np.full(len(left), _NO_MERGE) if before is None else before.astype(np.int64)
        holds, open_ = np.ones(len(left), bool), np.arange(len(left))
        while len(open_):
            x, y, lim = left[open_], right[open_], limit[open_]
            broken = self._merge(x, y) < lim
            holds[open_[broken]] = False
            open_, x, y = open_[~broken], x[~broken], y[~broken]
            x_in, y_in = self.right[x], self.left[y]
            x_base, y_base = x_in == x, y_in == y
            take_left = np.where(x > y, ~x_base, y_base & ~x_base)
            limit[open_] = np.where(take_left, x, y + 1)
            left[open_] = np.where(take_left, x_in, x)
            right[open_] = np.where(take_left, y, y_in)
            open_ = open_[~(x_base & y_base)]
        return holds

    def _sound_tokens(self, made: np.ndarray) -> np.ndarray:
        """Tokens whose own letters encode to just them."""
        sound = np.ones(len(self.left), bool)
        border = self.compatible(self.left[made], self.right[made], made)
        for z, ok in zip(made.tolist(), border.tolist(), strict=True):
            sound[z] = ok and sound[self.left[z]] and sound[self.right[z]]
        return sound

    def _build_trie(self, symbols: dict[int, list[int]]) -> None:
        """Tokens as paths of bytes; a token that ends words has the end symbol as its last step."""
        steps: dict[int, int] = {}
        accepts = [-1]
        for token, path in symbols.items():
            node = 0
            for x in path:
                if (node << 9 | x) not in steps:
                    steps[node << 9 | x] = len(accepts)
                    accepts.append(-1)
                node = steps[node << 9 | x]
            accepts[node] = token
        self._accepts = np.array(accepts)
        self._steps = IntTable(np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps)), -1)
        first = self._steps.get(np.arange(256))
        self._inner_byte = self._accepts[first]
        self._final_byte = self._accepts[self._steps.get(first << 9 | _END)]

    def _propose(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token from the left, again and again, for all words side by side.

        symbols: the bytes of all words, each word followed by the end symbol. Returns the tokens in
        order and, for each, where it ends in symbols.
        """
        at, node = starts.copy(), np.zeros(len(starts), np.int64)
        best, best_end = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        tokens, ends = [], []
        padded = np.r_[symbols, _END]
        while len(at):
            node = self._steps.get(np.maximum(node, 0) << 9 | padded[at])
            moved = node >= 0
            at = at + moved
            token = np.where(moved, self._accepts[node], -1)
            # a token inside a word leaves something of the word to come
            good = (token >= 0) & ((padded[at] != _END) | (padded[at - 1] == _END))
            best, best_end = np.where(good, token, best), np.where(good, at, best_end)
            stop = ~moved | (padded[at - 1] == _END)
            if stop.any():
                tokens.append(best[stop])
                ends.append(best_end[stop])
                at = np.where(stop, best_end, at)
                node = np.where(stop, 0, node)
                open_ = ~stop | (padded[at - 1] != _END)
                at, node, best, best_end = at[open_], node[open_], best[open_], best_end[open_]
        tokens, ends = np.concatenate(tokens), np.concatenate(ends)
        order = np.argsort(ends)
        return tokens[order], ends[order]

    def _exact(self, tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain merging of many words at once: in each round every word merges its oldest possible pair.

        tokens: those of single bytes; owner: the word of each, ascending. Of overlapping equal pairs (as in
        "aaa") the leftmost goes first, as runs of them alternate.
        """
        settled_tokens, settled_owner = [], []
        while len(tokens):
            made = np.full(len(tokens), _NO_MERGE)
            made[:-1] = self._merge(tokens[:-1], tokens[1:])
            made[:-1][owner[:-1] != owner[1:]] = _NO_MERGE
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(made, starts), np.diff(np.r_[starts, len(tokens)]))
            hit = (made == best) & (made < _NO_MERGE)
            for i in (np.flatnonzero(hit[1:] & hit[:-1]) + 1).tolist():  # words that repeat a token
                hit[i] = not hit[i - 1]
            settled = best == _NO_MERGE
            settled_tokens.append(tokens[settled])
            settled_owner.append(owner[settled])
            keep = ~settled
            keep[1:] &= ~hit[:-1]
            tokens, owner = np.where(hit, made, tokens)[keep], owner[keep]
        tokens, owner = np.concatenate(settled_tokens), np.concatenate(settled_owner)
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (little-endian unsigned 32-bit): proposed, checked, and merged exactly where a check fails."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1)
        symbols = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        symbols[stops - 1] = _END
        tokens, ends = self._propose(symbols, stops - sizes - 1)
        owner = np.searchsorted(stops, ends, side="left")
        fails = np.zeros(len(words), bool)
        fails[owner[~self._sound[tokens]]] = True
        inside = owner[:-1] == owner[1:]
        pairs, back = np.unique((tokens[:-1] << 20 | tokens[1:])[inside], return_inverse=True)
        if len(pairs):
            ok = self.compatible(pairs >> 20, pairs & ((1 << 20) - 1))
            fails[owner[:-1][inside][~ok[back]]] = True
        self.proposed += len(words)
        self.remerged += int(fails.sum())
        if fails.any():
            letter_owner = np.repeat(np.arange(len(words)), sizes + 1)
            own = np.flatnonzero(fails[letter_owner] & (symbols != _END))
            single = self._inner_byte[symbols[own]]
            ending = symbols[own + 1] == _END
            single[ending] = self._final_byte[symbols[own[ending]]]
            exact, exact_owner = self._exact(single, letter_owner[own])
            good = ~fails[owner]
            tokens, owner = np.r_[tokens[good], exact], np.r_[owner[good], exact_owner]
            order = np.argsort(owner, kind="stable")
            tokens, owner = tokens[order], owner[order]
        raw = tokens.astype("<u4").tobytes()
        cut = (np.searchsorted(owner, np.arange(len(words) + 1)) * 4).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _plain(self, text: str) -> bytes:
        """A text in the vocabulary's normal form, its white space ASCII."""
        if text.isascii():
            text = text.lower()
            return (" ".join(NOT_SPACE.findall(text)) if ODD_SPLITS.search(text) else text).encode()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return " ".join(NOT_SPACE.findall(text) if ODD_SPLITS.search(text) else text.split()).encode("utf-8", "surrogatepass")

    def _learn(self, chunks: set[bytes]) -> None:
        """Puts the ids of new chunks in the cache. A chunk of several words is joined from theirs, which are cached too."""
        cache = self._cache
        words, several = [], {}
        for c in chunks:
            if c.isalpha():
                words.append(c)
            else:
                own = split_chunk(c.decode("utf-8", "surrogatepass"))
                if len(own) == 1:
                    words.append(c)
                else:
                    several[c] = [p.encode("utf-8", "surrogatepass") for p in own]
        if several:
            words += {p for own in several.values() for p in own if p not in cache}.difference(words)
        for at in range(0, len(words), LEARNED_TOGETHER):
            part = words[at : at + LEARNED_TOGETHER]
            cache.update(zip(part, self.encode_words(part), strict=True))
        for chunk, own in several.items():
            cache[chunk] = b"".join([cache[p] for p in own])

    def _encode_plain(self, raws: list[bytes]) -> list[bytes]:
        """Ids of texts in normal form; the words that none before had are learned together."""
        split = [d.split() for d in _apart(_BETWEEN.join(raws)).split(_BETWEEN)] if raws else []
        seen: set[bytes] = set().union(*split)
        self._learn(seen.difference(self._cache))
        cache = self._cache
        if len(cache) > CACHED_WORDS:  # the words of these texts stay, older ones go
            self._cache = {c: cache[c] for c in seen}
        return [b"".join(map(cache.__getitem__, chunks)) for chunks in split]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[list[bytes], int]] = []  # where the ids of each raw go
        raws: list[bytes] = []
        size = 0

        def finish() -> None:
            nonlocal size
            for (parts, i), ids in zip(held, self._encode_plain(raws), strict=True):
                parts[i] = ids
            held.clear()
            raws.clear()
            size = 0

        for parts, text in zip(out, texts, strict=True):
            if not text:
                continue
            for s in self._special_split.split(text) if self._special_split and "<|" in text else [text]:
                if s in self.specials:
                    parts.append(pack("<I", self.specials[s]))
                elif s:
                    held.append((parts, len(parts)))
                    parts.append(b"")
                    raws.append(self._plain(s))
                    size += len(s)
            if size > ENCODED_TOGETHER:
                finish()
        finish()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: token strings joined by spaces."""
        return " ".join(map(self.token_text.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One codec for each vocabulary file and Python worker."""
    return WordBpe(path)
