"""Whole texts to token ids with the tokenizers library, a distinct chunk at a time.

Tokenizers of two known shapes (``SHAPES``) split a text at white space before
any merge, so the ids of a text are those of its chunks in order.  Each Python
worker keeps the ids of chunks it has met (two generations of bounded bytes)
and gives the library only new ones, many in one string.  tests/llm compares
with the library's ids of whole texts.  A tokenizer file of any other shape is
given whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, filterfalse, pairwise
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GENERATION = 64 << 20  # bytes of one of the two generations of chunks that a worker keeps
ENTRY = 133  # bytes of a dictionary's entry beside its key and the ids in its value
PASS = (4096, 6 << 20)  # rows or bytes of text that make a batch large enough, so that few of its chunks are distinct
JOIN = 2_000  # new chunks given to the library in one string
# A word of Latin letters with signs (ASCII's but for the apostrophe) right after it: two pieces for either vocabulary.
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# What follows white space as the byte-level patterns know it (U+001C to U+001F are none).
CHUNKS = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")
AS_IS = "\x1c"  # begins a chunk that stands for the rest of its string
# Texts with white space other than single spaces and line ends between words, and empty ones.
ODD = r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x{0b}-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
OTHER_SPACE = r"[\t\x{0b}-\r]"
COMBINING = r"[\x{300}-\x{37f}]"
# What a tokenizer file must say for the chunks to be right: normalizer, pre-tokenizer, and the model's settings.
BPE = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
SHAPES = {
    "word": {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
        "model": BPE | {"end_of_word_suffix": "</w>"},
    },
    "byte": {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "model": BPE | {"end_of_word_suffix": None}},
}


def shape_of(path: str) -> str:
    """``word`` or ``byte`` if the tokenizer file is of that shape, else ``whole``."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    said = {k: said.get(k) for k in ("normalizer", "pre_tokenizer", "truncation", "padding")} | {
        "model": {k: v for k, v in said["model"].items() if k not in ("vocab", "merges")},
        "plain": [t for t in said.get("added_tokens", []) if not t.get("special") or t.get("normalized")],  # would be found in ordinary text
    }
    for kind, shape in SHAPES.items():
        if said == shape | {"truncation": None, "padding": None, "plain": []}:
            return kind
    return "whole"


class Encoder:
    """Ids as bytes: little-endian unsigned 16-bit, or 32-bit for large vocabularies."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.known: dict = {"": b""}
        self.older: dict = {}
        self.held = 0  # bytes of ``known``, about

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each string, without special tokens."""
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Each text's ids; a null text has none.  Arrow splits a batch and numbers its distinct chunks."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(column):
            return []
        parts = self.split(pc.fill_null(column.cast(pa.large_string()), ""))
        chunks = parts.flatten().dictionary_encode()
        ids = pa.array(self.look_up(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8) if len(ids) else np.zeros(1, np.int64)
        cuts = parts.offsets.to_numpy()
        cuts = ends[cuts - cuts[0]].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[s:e]) for s, e in pairwise(cuts)]

    def look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks.  What was met in the last generation moves to this one."""
        if self.held > GENERATION:
            self.known, self.older, self.held = {"": b""}, self.known, 0
        known, older = self.known, self.older
        found = list(map(known.get, chunks))
        unmet = [i for i, ids in enumerate(found) if ids is None]
        if not unmet:
            return found
        names = [chunks[i] for i in unmet]
        got = list(map(older.get, names))  # each table is probed once, since that is what takes the time
        new = [c for c, ids in zip(names, got, strict=True) if ids is None]
        if new:
            fresh = self.learn(new)
            got = [fresh[c] if ids is None else ids for c, ids in zip(names, got, strict=True)]
        known.update(zip(names, got, strict=True))
        self.held += ENTRY * len(names) + sum(map(getsizeof, names)) + sum(map(len, got))
        for i, ids in zip(unmet, got, strict=True):
            found[i] = ids
        return found

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Words followed by signs are put together from their two pieces; the rest goes to the library."""
        fresh: dict[str, bytes] = {}
        plain, pairs = [], []
        for chunk in new:
            word = "" if chunk.isalpha() else chunk.rstrip(SIGNS)
            if word and len(word) < len(chunk) and LATIN(word):
                pairs.append((chunk, word, self.bare(chunk[len(word) :])))
            else:
                plain.append(chunk)
        for _, word, signs in pairs:
            if word not in fresh:
                fresh[word] = self.known.get(word)
            if signs not in fresh:
                fresh[signs] = self.known.get(signs)
        plain += [c for c in {k for k, ids in fresh.items() if ids is None}.difference(plain)]
        for i in range(0, len(plain), JOIN):
            part = plain[i : i + JOIN]
            fresh.update(zip(part, self.learn_plain(part), strict=True))
        for chunk, word, signs in pairs:
            fresh[chunk] = fresh[word] + fresh[signs]
        return fresh


class WordEncoder(Encoder):
    """For vocabularies that lower case and drop white space; chunks are what lies between white space."""

    @staticmethod
    def split(texts: pa.Array) -> pa.ListArray:
        # The replacement also makes a column of its own: Arrow's lower case misreads slices.
        spaced = pc.replace_substring(texts, "\n", " ")
        if pc.any(pc.match_substring_regex(spaced, OTHER_SPACE)).as_py():
            spaced = pc.replace_substring_regex(spaced, OTHER_SPACE, " ")
        # Lower case beforehand is safe unless a combining mark could compose differently.
        lowered = pc.if_else(pc.match_substring_regex(spaced, COMBINING), spaced, pc.ascii_lower(spaced))
        # Neighbouring spaces give empty chunks, which have no ids.
        return pc.split_pattern(lowered, " ")

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers

        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # The same model without the normalizer and pattern, for words that both leave as they are.
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    bare = staticmethod(lambda s: s)

    def learn_plain(self, chunks: list[str]) -> list[bytes]:
        """Latin words go to the library together, since a word's last token says that it ends there; NFC leaves them as they are."""
        latin = [bool(LATIN(c)) for c in chunks]
        joint = list(compress(chunks, latin))
        ids = np.array(self.words.encode_batch_fast([" ".join(joint).lower()], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(joint):
            raise ValueError("words did not stay apart")
        raw, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
        together = (raw[s:e] for s, e in pairwise([0, *ends]))
        alone = (own.tobytes() for own in self.ids([c for c, one in zip(chunks, latin, strict=True) if not one]))
        return [next(together if one else alone) for one in latin]


def byte_chunks(text: str) -> list[str]:
    """A text cut where no byte-level piece crosses: before white space.

    A chunk is a word without the one space before it, a line end with the word
    after it, or ``AS_IS`` and a string as it stands.
    """
    if not text:
        return []
    # Single spaces and line ends only, between words.
    if len(text.split()) == text.count(" ") + text.count("\n") + 1 and AS_IS not in text:
        parts = text.replace("\n", " \n").split(" ")
        if "" not in parts and "\n" not in parts:  # other white space can make up for double spaces
            parts[0] = AS_IS + parts[0]
            return parts
    return [AS_IS + c for c in CHUNKS.findall(text)]


def chunk_text(chunk: str) -> str:
    """What a chunk of a byte-level vocabulary stands for in the text."""
    return chunk[1:] if chunk[0] == AS_IS else chunk if chunk[0] == "\n" else " " + chunk


class ByteEncoder(Encoder):
    """For byte-level vocabularies, where a word's first token holds the space before it; chunks are those of ``byte_chunks``."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True

    @staticmethod
    def split(texts: pa.Array) -> pa.ListArray:
        odd = pc.match_substring_regex(texts, ODD)
        begun = pc.binary_join_element_wise(pa.scalar(AS_IS, pa.large_string()), texts, pa.scalar("", pa.large_string()))
        plain = pc.split_pattern(pc.replace_substring(begun, "\n", " \n"), " ")
        if not pc.any(odd).as_py():
            return plain
        cut = [byte_chunks(t) for t in texts.filter(odd).to_pylist()]
        both = pa.concat_arrays([plain.filter(pc.invert(odd)), pa.array(cut, plain.type)])
        is_odd = odd.to_numpy(zero_copy_only=False)
        place = np.where(is_odd, (~is_odd).sum() + np.cumsum(is_odd), np.cumsum(~is_odd)) - 1
        return both.take(pa.array(place))

    bare = staticmethod(lambda s: AS_IS + s)

    def learn_plain(self, chunks: list[str]) -> list[bytes]:
        """Chunks that begin with a space go to the library together, since a word's first token holds it."""
        spaced = [c[0] not in "\n\x1c" for c in chunks]
        joint = list(compress(chunks, spaced))
        ids = self.ids([" " + " ".join(joint) if joint else ""])[0]
        cuts = np.flatnonzero(self.begins[ids])
        if len(cuts) != len(joint):
            raise ValueError("words did not stay apart")
        raw, cuts = ids.tobytes(), (cuts * ids.itemsize).tolist()
        together = (raw[s:e] for s, e in pairwise([*cuts, len(raw)]))
        alone = (own.tobytes() for own in self.ids([chunk_text(c) for c, one in zip(chunks, spaced, strict=True) if not one]))
        return [next(together if one else alone) for one in spaced]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = PASS[0], size: int = PASS[1]) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they have ``rows`` rows or ``size`` bytes."""
    held, n, full = [], 0, 0
    for b in batches:
        held.append(b)
        n, full = n + b.num_rows, full + b.nbytes
        if n >= rows or full >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, full = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class WholeEncoder(Encoder):
    """For any other tokenizer: whole texts to the library, nothing kept."""

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        plain = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        return [ids.tobytes() for ids in self.ids([t or "" for t in plain])]


KINDS = {"word": WordEncoder, "byte": ByteEncoder, "whole": WholeEncoder}


@lru_cache(maxsize=4)
def encoder(path: str, kind: str | None = None) -> Encoder:
    """One encoder per Python worker and file; a ``kind`` that the file's shape does not allow is an error."""
    shape = shape_of(path)
    if kind not in (None, "whole", shape):
        raise ValueError(f"{path} is not a tokenizer of the shape {kind!r}; leave the kind out to encode it as {shape!r}")
    return KINDS[kind or shape](path)
