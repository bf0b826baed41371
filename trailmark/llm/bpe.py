"""Byte-level BPE of a tokenizer file, and a shortcut that gives the same ids or counts faster.

The library tokenizes about 1.5 MB a second and core, so most texts take another way: their pre-tokens come from the published
pre-token pattern; for counts, only distinct pre-tokens are merged; for ids, a library that merges by rank does it.  The shortcut is
proved when the file is opened: the file must use that pattern without changing texts before, and for counts every character of the
basic plane and of the emoji blocks is split by both regular-expression engines, beside letters, digits, signs and blanks; those that
both split alike are common.  For ids common characters are fixed below: letters and signs that every Unicode version since 1.1 classes
alike.  Any other text, and any text that holds a special string, goes through the library itself.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
import regex

#: The pre-token pattern that goes with byte_bpe_50k.json (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_odd = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ȗΑ-ΡΣ-Ωα-ωА-яぁ-ゔァ-ヺ一-龥]").search
_long = re.compile(r"\s{1000}").search
#: Merged pre-tokens that a process remembers.
REMEMBERED = 400_000
_loaded: dict[str, Bpe] = {}


class Bpe:
    """One tokenizer file, opened once in each process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall
        self.usual = self._uses_pattern()
        self.odd_for_counts = self._odd_characters() if self.usual else _odd
        self.whole = self._whole_tokens()
        self.counts: dict[str, int] = dict(self.whole)
        self.path: str = path
        self.ranked: object = False  # not yet opened

    def _whole_tokens(self) -> dict[str, int]:
        """The vocabulary strings that stand alone as one pre-token and encode as exactly one id: the proof for the shortcut."""
        ids = list(self.library.get_vocab(with_added_tokens=False).values())
        texts = self.library.decode_batch([[i] for i in ids], skip_special_tokens=False)
        both = [(t, i) for t, i in zip(texts, ids, strict=True) if t and "�" not in t and self.split(t) == [t]]
        encoded = self.library.encode_batch_fast([t for t, _ in both], add_special_tokens=False)
        return {t: 1 for (t, i), e in zip(both, encoded, strict=True) if e.ids == [i]}

    def _uses_pattern(self) -> bool:
        """The file splits texts by PATTERN, unchanged."""
        file = json.loads(self.library.to_str())
        how = file["pre_tokenizer"] or {}
        return file["normalizer"] is None and how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space", True)

    def _odd_characters(self):
        """A search for characters that the two engines may split differently: all beyond the proved blocks, and those found to differ."""
        tried = [chr(c) for c in [*range(0x20), *range(0x7F, 0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x1FC00)]]
        different = []
        for lo in range(0, len(tried), 4096):
            part = tried[lo : lo + 4096]
            text = "".join(f"a{c}1 {c}! {c}{c}b\n" for c in part)
            theirs = [end for _, (_, end) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            ours = np.cumsum([len(t) for t in self.split(text)])
            for at in np.unique(np.setxor1d(theirs, ours) // 11):  # eleven characters each
                different += part[max(0, at - 1) : at + 1]  # a border at a unit's end may be the next one's
        apart = "|[" + re.escape("".join(dict.fromkeys(different))) + "]" if different else ""
        return re.compile("[^\x00-\ud7ff\ue000-\uffff\U0001f000-\U0001fbff]" + apart).search

    def plain(self, text: str, odd=_odd) -> bool:
        return self.usual and not (odd(text) or _long(text) or any(s in text for s in self.special))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text: a pre-token that is a whole token counts one, the rest are merged once each."""
        out = [0] * len(texts)
        if len(self.counts) > REMEMBERED:
            self.counts = dict(self.whole)
        split: list[tuple[int, list[str]]] = []
        rest: set[str] = set()
        for i, t in enumerate(texts):
            if self.plain(t, self.odd_for_counts):
                split.append((i, got := self.split(t)))
                rest.update(itertools.filterfalse(self.counts.__contains__, got))
            else:
                out[i] = len(self.library.encode(t, add_special_tokens=False).ids)
        if rest:
            merge = list(rest)
            self.counts.update(zip(merge, map(len, self.library.encode_batch_fast(merge, add_special_tokens=False)), strict=True))
        for i, got in split:
            out[i] = sum(map(self.counts.__getitem__, got))
        return out

    def _by_rank(self, path: str):
        """The same vocabulary as ranks, if merges are in the order of their ids: then merging by rank gives the library's ids."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level vocabularies show other bytes from U+0100 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merges]
        if ids != sorted(set(ids)) or set(model["vocab"]) != set(merges) | set(byte):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}
        return tiktoken.Encoding("by-rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if self.ranked is False:
            self.ranked = self._by_rank(self.path)
        fast = self.ranked
        return [
            (fast.encode_to_numpy(t, disallowed_special=()) if fast is not None and self.plain(t) else np.array(self.library.encode(t, add_special_tokens=False).ids)).astype("<u4").tobytes()
            for t in texts
        ]


def bpe(path: str) -> Bpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def batches_of(texts: list[str], size: int = 1 << 20):
    """Runs of texts of about ``size`` characters, one text at least."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield texts[lo : i + 1]
            lo, total = i + 1, 0
    if lo < len(texts):
        yield texts[lo:]
