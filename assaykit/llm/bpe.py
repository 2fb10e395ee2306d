"""BPE encoding and decoding with forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can't be joined by any merge, so a cut between
the two is certain. Of those pairs the ones used here end in white space and begin with something else: there
the pre-tokenizer splits as well, looks only ahead from there, and so what lies on both sides can be encoded
alone. The fragments (a word with the white space before it) are encoded once each and their ids concatenated.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assaykit.llm.common import map_batches, quiet_tokenizers

#: Fixed value: the white space of the tokenizers' patterns.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fragments of a generation whose ids are remembered by a worker, which keeps two, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64
#: Characters of text whose new fragments are learnt together, and fragments in one text given to the tokenizer.
TOGETHER, JOINED = 1 << 19, 4096

#: Lower-case words of Latin-1 letters alone, signs alone, and the one with the other after it: without the apostrophe, which begins tokens of its own.
WHOLE = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
HALVES = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = byte_letters()
    names = {i: t for t, i in data["model"]["vocab"].items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
    return [bytes(letters[c] for c in names[i]) if i in names and all(c in letters for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether no token has the two bytes side by side."""
    inside = np.zeros((256, 256), bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8)
        inside[b[:-1], b[1:]] = True
    return ~inside


def uncertain_ends(forced: np.ndarray) -> set[int]:
    """Bytes after which a cut before ASCII white space isn't certain."""
    blanks = [9, 10, 11, 12, 13, 32]
    return {b for b in range(256) if b not in blanks and not forced[b, blanks].all()}


def fragment_pattern(forced: np.ndarray) -> str:
    """A word with the white space before it. After a character whose last byte is uncertain the fragment goes on;
    of the characters beyond U+FFFF none ends one if any byte is uncertain."""
    ends = uncertain_ends(forced)
    if any(b < 0x80 for b in ends):
        return r"(?s).+"
    word = f"[{SPACES}]*[^{SPACES}]+"
    if ends:
        joined = "".join(re.escape(chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and (0x80 | c & 0x3F) in ends)
        word += f"(?:(?<=[{joined}\U00010000-\U0010ffff])[{SPACES}]+[^{SPACES}]*)*"
    return f"{word}|[{SPACES}]+"


class Encoder:
    """Encodes texts by fragments. word_ends: the vocabulary marks word ends and drops white space."""

    def __init__(self, path: str, word_ends: bool = False):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: ids of fragments met of late, and of those met before; what is met again moves to the newer ones
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.word_ends = word_ends
        if word_ends:
            self.fragments = re.compile(f"[^{SPACES}]+").findall
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            return
        self.tokens = token_bytes(path)
        self.fragments = re.compile(fragment_pattern(forced_pairs(self.tokens))).findall
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.letters = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text and the place of the character that each begins in."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, "<u4"), np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))

    def _joined(self, missing: list[str], between: str) -> None:
        """Learn fragments that can be encoded in one text; tokens of what lies between them are left out."""
        for at in range(0, len(missing), JOINED):
            some = missing[at : at + JOINED]
            ids, places = self._encode(between.join(some))
            sizes = np.array([len(f) for f in some]) + len(between)
            starts = np.cumsum(sizes) - sizes
            owner = np.searchsorted(starts, places, side="right") - 1
            inside = places - starts[owner] < sizes[owner] - len(between)
            ids, owner = ids[inside], owner[inside]
            data, cuts = ids.tobytes(), (np.searchsorted(owner, np.arange(len(some) + 1)) * 4).tolist()
            self.ids.update((f, data[x:y]) for f, x, y in zip(some, cuts[:-1], cuts[1:]))

    def _whole(self, words: list[str]) -> None:
        """Learn words that the pre-tokenizer leaves whole: each ends with the next id that ends a word."""
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, cuts = ids.tobytes(), ((np.nonzero(self.ends[ids])[0] + 1) * 4).tolist()
            self.ids.update((f, data[x:y]) for f, x, y in zip(some, [0, *cuts[:-1]], cuts, strict=True))

    def _learn(self, missing: list[str]) -> None:
        if self.word_ends:
            # a word of letters and what hangs on it are tokens of their own: most new words are old ones with a sign
            known = self.ids
            halves, parts = {}, set()
            for f in missing:
                if f.isalpha() or not (m := HALVES.fullmatch(f)):
                    parts.add(f)
                else:
                    halves[f] = m.groups()
                    parts.update(p for p in halves[f] if p not in known)
            whole = {p for p in parts if p.isascii() and p.isalpha() and p.islower() or WHOLE.fullmatch(p)}
            self._whole(list(whole))
            self._joined(list(parts - whole), " ")
            self.ids.update((f, self.ids[a] + self.ids[b]) for f, (a, b) in halves.items())
            return
        blank = set(" \t\n\x0b\x0c\r")
        led = [f for f in missing if f[0] in blank and f[-1].isalnum() and f[-1].isascii()]
        bare = [f for f in missing if f[0].isalnum() and f[-1].isalnum() and f[-1].isascii()]
        self._joined(led, "")  # each begins with a cut
        self._joined(bare, "\n")  # a line feed is a token of its own before a letter or digit
        rest = list(set(missing).difference(led, bare))
        for f, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.ids[f] = np.array(e.ids, "<u4").tobytes()

    def _recall(self, new: set[str]) -> None:
        """Ids of fragments that the newer generation lacks: from the older one, or learnt."""
        again = [f for f in new if f in self.older]
        self.ids.update(zip(again, map(self.older.__getitem__, again)))
        new.difference_update(again)
        if new:
            self._learn(list(new))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        held, new, size = [], set(), 0
        for i, text in enumerate(texts):
            parts = self.split(text or "")
            found = list(map(self.ids.get, parts))
            gaps = [k for k, ids in enumerate(found) if ids is None] if None in found else []
            new.update([parts[k] for k in gaps])
            held.append((parts, found, gaps))
            size += len(text or "")
            if size < TOGETHER and i < len(texts) - 1:
                continue
            long = [f for f in new if len(f) > LONGEST]
            if new:
                self._recall(new)
            known = self.ids
            for parts, found, gaps in held:
                for k in gaps:
                    found[k] = known[parts[k]]
                out.append(b"".join(found))
            for f in long:
                del known[f]
            if len(known) > REMEMBERED:
                self.ids, self.older = {}, known
            held, new, size = [], set(), 0
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def split(self, text: str) -> list[str]:
        """Fragments of a text. str.split() also splits at four control characters, which the patterns don't."""
        if not self.word_ends or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.fragments(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return text.lower().split()  # as the normalizer does, letter by letter; beyond Latin-1 that isn't sure

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids of a byte-level vocabulary; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for at in range(0, len(ids), 1 << 20):
            part = ids[at : at + (1 << 20)]
            n = self.lengths[part]
            before = np.cumsum(n) - n
            out.append(self.letters[np.repeat(self.starts[part] - before, n) + np.arange(n.sum())].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, word_ends: bool = False) -> Encoder:
    return Encoder(path, word_ends)


def ids_array(parts: list[bytes]) -> pa.Array:
    """An Arrow list of integers for each item."""
    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row: the ids of its whole text, and the text of those ids.

    A null or empty text has no ids and decodes to the empty text. Repeated rows stay; other columns don't matter.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = encoder(path)
        parts = codec.encode_all(batch.column(1).to_pylist())
        decoded = [codec.decode(np.frombuffer(p, "<u4")) for p in parts]
        return pa.RecordBatch.from_arrays([batch.column(0), ids_array(parts), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return map_batches(docs.select("doc_id", text), run, "doc_id bigint, ids array<int>, decoded string")
