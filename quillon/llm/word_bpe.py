"""Word-level BPE files (end-of-word suffix, white space dropped) read without the library's own merges.

The library's normalizer and pre-tokenizer cut the text; the merges are ours. A text is first cut at single spaces.
The file's pre-tokenizer drops white space and none of its patterns crosses it, and normalization (NFC, lower case)
does not compose across a space, so each piece can be encoded alone and kept for the next time it is met.
"""

from __future__ import annotations

import heapq
import json
import os
import re

#: Bytes of pieces and words kept per Python worker; beyond this they are forgotten and worked out again.
CACHE_BYTES = 192 << 20

#: A word and the signs after it, which the pattern always parts; normalization only lower-cases these letters.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def byte_spelling() -> dict[int, str]:
    """The character that stands for each byte: itself if it shows, else the next free one from 256 on."""
    shows = lambda b: 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
    hidden = [b for b in range(256) if not shows(b)]
    return {b: chr(b) if shows(b) else chr(256 + hidden.index(b)) for b in range(256)}


_SPELL = {ord(bytes([b]).decode("latin-1")): c for b, c in byte_spelling().items()}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """Vocabulary, ranks and the way to cut words of one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left id, right id) -> (rank, id of the merged token)
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self._special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        whole = Tokenizer.from_file(path)
        self._normalize, self._cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str

    def words(self, piece: str) -> list[str]:
        """The pre-tokens of a piece without spaces, as the vocabulary spells bytes; special tokens as they are."""
        if plain := _PLAIN.fullmatch(piece):
            word, signs = plain[1].lower(), plain[2]
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_SPELL)
            return [word, signs] if signs else [word]
        if "<|" in piece and self._special_at.search(piece):
            return [
                w
                for part in self._special_at.split(piece)
                for w in ([part] if part in self.special else self.words(part) if part else [])
            ]
        return [w for w, _ in self._cut(self._normalize(piece))]

    def symbols(self, word: str) -> list[int]:
        """The ids a word starts from: its bytes, the last one with the suffix."""
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]

    def merged(self, ids: list[int]) -> list[int]:
        """One word's tokens: the lowest rank first, the leftmost first among equals."""
        merges, n = self.merges, len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = merges[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in merges:
                    heapq.heappush(heap, (merges[p][0], i, p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in merges:
                heapq.heappush(heap, (merges[p][0], before[i], p))
        return [t for t in ids if t >= 0]

    def whole_tokens(self) -> frozenset[str]:
        """The words whose merges end in one token, proved by doing the merges of every vocabulary string."""
        ended = (s[: -len(self.suffix)] for s in self.vocab if s.endswith(self.suffix) and len(s) > len(self.suffix))
        return frozenset(w for w in ended if len(self.merged(self.symbols(w))) == 1)


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One copy per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
