"""Token ids of whole texts with the tokenizers library, each distinct word encoded once in a worker."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word of letters up to U+00FF, then ASCII punctuation: two pre-tokens whose normal form is their lower case.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: The normal form and the cut into pre-tokens that the quick way below presumes. Fixed values.
NORMAL = ["NFC", {"Replace": [r"\s+", " "]}, "Lowercase"]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker remembers, about, before it forgets all and starts anew.
REMEMBERED = 1_000_000


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to ids, as encode(text, add_special_tokens=False) gives them.

    A tokenizer file of another normal form or cut than NORMAL and CUT, or of another model than BPE with word ends, goes through
    the library text by text. Else white space is dropped: a space or line feed ends a pre-token and has no id of its own, so texts are cut there and distinct chunks encoded once.
    Chunks of plain letters and punctuation go to the library's BPE model as two pre-tokens; any other goes through the
    library's whole pipeline.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.quick = self._presumed()
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}  # byte-level alphabet
        self.chunks: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _presumed(self) -> bool:
        """Whether the file's normaliser, pre-tokenizer and model are those that the quick way is right for."""
        state = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        steps = [x["type"] if x["type"] != "Replace" else {"Replace": [x["pattern"].get("Regex"), x["content"]]} for x in state(self.library.normalizer).get("normalizers", [])]
        cuts = state(self.library.pre_tokenizer).get("pretokenizers", [])
        if steps != NORMAL or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
            return False
        split, level = cuts
        model = self.library.model
        return (split["pattern"].get("Regex") == CUT and split["invert"] and split["behavior"] == "Removed" and not level["add_prefix_space"] and not level["use_regex"]
                and type(model).__name__ == "BPE" and model.end_of_word_suffix == "</w>" and not model.dropout)

    def forget(self) -> None:
        """A worker serves many tasks; what one has learnt must not stay in its memory."""
        self.chunks, self.marks = {}, {"": b""}

    def _piece(self, piece: str, known: dict[str, bytes]) -> bytes:
        if (ids := known.get(piece)) is None:
            level = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_chars)
            ids = known[piece] = np.array([t.id for t in self.library.model.tokenize(level)], "<u4").tobytes()
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if m := PLAIN.fullmatch(chunk):  # letters alone are a chunk as well, so both are remembered in one place
            letters = self._piece(m[1].lower(), self.chunks)
            return letters + self._piece(m[2], self.marks) if m[2] else letters
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint32, how many each text has); null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not self.quick:
            some = [x.ids for x in self.library.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            n = np.fromiter(map(len, some), np.int64, len(some))
            return np.fromiter((i for x in some for i in x), np.uint32, int(n.sum())), n
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        if len(self.chunks) > REMEMBERED:
            self.forget()
        known, found = self.chunks, []
        for chunk in coded.dictionary.to_pylist():
            if (ids := known.get(chunk)) is None:
                ids = known[chunk] = self._chunk(chunk)
            found.append(ids)
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, first, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(length) - length, coded.indices.to_numpy()
        n = length[at]
        ends = np.cumsum(n)
        ids = pool[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return ids, np.diff(np.concatenate([[0], ends])[offsets])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_ended(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As Encoder.encode, with end_id behind each text's ids."""
    ids, n = encoder(path).encode(texts)
    return np.insert(ids, np.cumsum(n), end_id), n + 1
