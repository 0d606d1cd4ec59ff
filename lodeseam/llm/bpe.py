"""Exact token ids of a byte-level BPE file of the tokenizers library, with a cache of pieces.

A byte-level pre-tokeniser never lets a token run from a non-space character into white space, so a text may be cut
at every such place: the ids of the parts, put one after the other, are the ids of the text. Parts recur (words do), so
each worker keeps the ids of those it has seen lately. Texts with the string of a special token are encoded whole.
"""

from __future__ import annotations

import contextlib
import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Parts in each of the two generations that a worker keeps, some 250 bytes each; longer parts than CACHE_CHARS aren't kept.
CACHE_PARTS = 350_000
CACHE_CHARS = 64
#: Characters whose unknown parts are encoded in one call.
TOGETHER = 400_000

_CUT = re.compile("(?<=[^ \\t-\\r\x85\xa0  -     　])(?=[ \\t-\\r\x85\xa0  -     　])")
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """ids(texts): each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends = {c: self._encode(c) for c in ".,;:"}
        # which ids begin with a space or a line end
        table = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(table.values()) + 1, bool)
        self.begins[[i for t, i in table.items() if t[0] in "\u0120\u010a"]] = True

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Of parts other than a text's first, encoded at once and told apart by the ids that begin with white space."""
        if not parts:
            return []
        joined = "".join([p if p[0] == "\n" else " " + p for p in parts])
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (4 * np.flatnonzero(self.begins[ids])).tolist()
        data = ids.tobytes()
        cuts.append(len(data))
        if len(cuts) != len(parts) + 1:
            raise AssertionError("the vocabulary is not byte-level")
        return [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _parts(text: str) -> list[str]:
        """The text cut at every space and line end: a word stands for itself behind a space, one behind a line end keeps
        that, and the text's first has \\x00 before it. Where white space isn't single, a part ends in it or is empty."""
        parts: list[str] = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = "\n" + words[0]
            parts += words
        parts[0] = "\x00" + parts[0][1:]
        return parts

    def _whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._encode(text)
        return b"".join([self._encode(p) for p in _CUT.split(text)]) if text else b""

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text in turn; a group of texts is in memory at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._ids(group)
                group, size = [], 0
        yield from self._ids(group)

    def _ids(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > CACHE_PARTS:
            self.old, self.young = self.young, {}
        young, old, ends, missing, todo, out = self.young, self.old, self.ends, {}, [], []
        for text in texts:
            if not text or "\x00" in text or any(x in text for x in self.special):
                out.append(self._whole(text))
                continue
            parts = self._parts(text)
            found = list(map(young.get, parts))
            if None in found:
                lacks, k = [], found.index(None)
                while k >= 0:
                    p = parts[k]
                    if (x := old.get(p)) is not None:
                        young[p] = found[k] = x
                    elif not p or p[-1].isspace() or p == "\x00":
                        lacks = None  # such parts are never kept, so none can be found
                        break
                    elif p[-1] in ends and p[-2:-1].isalpha():  # letters and what follows are never one token
                        if (x := young.get(p[:-1]) or old.get(p[:-1])) is not None:
                            young[p] = found[k] = x + ends[p[-1]]
                        else:
                            missing[p[:-1]] = None
                            lacks.append(k)
                    else:
                        missing[p] = None
                        lacks.append(k)
                    try:
                        k = found.index(None, k + 1)
                    except ValueError:
                        break
                if lacks is None:
                    out.append(self._whole(text))
                    continue
                if lacks:
                    todo.append((len(out), parts, found, lacks))
                    out.append(b"")
                    continue
            out.append(b"".join(found))
        if missing:
            later = [p for p in missing if p[0] != "\x00"]
            missing.update(zip(later, self._encode_parts(later), strict=True))
            missing.update((p, self._encode(p[1:])) for p, x in missing.items() if x is None)
            young.update((p, x) for p, x in missing.items() if len(p) <= CACHE_CHARS)
            for at, parts, found, lacks in todo:
                for k in lacks:
                    p = parts[k]
                    if (x := missing.get(p)) is None:
                        x = missing[p[:-1]] + ends[p[-1]]
                    found[k] = x
                out[at] = b"".join(found)
        return out


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@contextlib.contextmanager
def no_cycles():
    """Encoding makes millions of small tuples and no cycles; without this Python would look through the cache again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def default_path() -> str:
    """Where the public 50k byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
