"""Token ids of whole texts by the ``tokenizers`` library, with words looked up once per worker.

The byte-level vocabulary cuts a text into words before it merges, and always cuts before a single space between
two other characters and before a single line break. So a text may be cut there, every distinct piece be encoded by the
library once, and the ids be joined: the result is that of encoding the whole text. A text with other white
space is cut only where that still holds, and its pieces with white space inside or at the end are encoded one by
one. A text that has the literal of an added token goes to the library whole. ``tests/llm/test_tokenizing.py`` compares
both ways.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tradewind.llm.shared import give_back

# Distinct units kept per Python worker; then the table starts anew. Bounds memory, not results.
CACHE_WORDS = 1_000_000
# Characters encoded at a time, or one text.
BLOCK_CHARS = 10_000_000
LINES = 5_000  # pieces given to the library at a time

# White space of any kind, and such that is neither one space nor one line break between other characters.
_SPACES = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD_SPACE = r"\n[ \n]| [ \n]|^[ \n]|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SAFE_CUT = f"([^{_SPACES}]) ([^{_SPACES}])"
# Marks put between pieces, before the first, and before units with no space before them; texts that have them go to the library whole.
_CUT, _FIRST, _BEHIND = "\x01", "\x02", "\x03"
_MARKS = ".,;:!?|&#$%*"
_MARKED = rf"^\p{{L}}+[{_MARKS}]+$"


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Units:
    """Distinct strings that the library has encoded, and the ids of each, all in one array."""

    def __init__(self):
        self.strings = pa.array([""], pa.string())
        self.ids = np.empty(0, "<u4")
        self.starts = self.sizes = np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.strings)

    def find(self, strings: pa.Array) -> np.ndarray:
        """Their numbers, -1 for those not here."""
        return pc.fill_null(pc.index_in(strings, value_set=self.strings), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.strings = pa.concat_arrays([self.strings, pa.array(strings, pa.string())])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])


class Encoder:
    def __init__(self, path: str):
        self.words, self.chars = CACHE_WORDS, BLOCK_CHARS
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_break = self._whole(["\n"])[0]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a character of a token stands for a byte
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known = Units()  # with one space before each, or after a line break or a word (see ``_units``)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts as the library has them, joined, and the number of each."""
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*found, np.empty(0, "<u4")]), np.array([len(f) for f in found], np.int64)

    def _each(self, lines: list[str], spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without white space (with one space before each, if ``spaced``). They go to the library joined by spaces or line breaks, before
        which it always cuts. By the bytes each id stands for, the result is cut there again; line breaks' ids go."""
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for at in range(0, len(lines), LINES):
            some = lines[at : at + LINES]
            found, _ = self._whole([" " + " ".join(some) if spaced else "\n" + "\n".join(some)])
            ends = np.cumsum(pc.binary_length(pa.array(some, pa.string())).to_numpy().astype(np.int64) + 1)
            reached = np.cumsum(self.width[np.minimum(found, len(self.width) - 1)])
            last = np.minimum(np.searchsorted(reached, ends), len(found) - 1)
            first = np.concatenate([[0], last[:-1] + 1])
            if (reached[last] != ends).any() or not (spaced or (found[first] == self.line_break[0]).all()):  # a vocabulary of another kind
                found, size = self._whole([" " + t for t in some] if spaced else some)
            elif spaced:
                size = np.diff(last, prepend=-1)
            else:
                found, size = np.delete(found, first), np.diff(last, prepend=-1) - 1
            ids.append(found)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, units: list[str]) -> None:
        """Adds units to the table."""
        behind = [u for u in units if u[0] == _BEHIND]
        spaced = [u for u in units if u[0] != _BEHIND]
        self.known.add(spaced, *self._each(spaced, spaced=True))
        self.known.add(behind, *self._each([u[1:] for u in behind]))

    def _found(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, joined, and where those of each begin and how many they are.

        A piece is at most two units, so that a word is known whatever marks stand behind it, as the vocabulary cuts them from it: a word and
        its marks, or a line break and the first word of its line, which has no space before it.
        """
        broken = pc.starts_with(pieces, "\n")
        marked = pc.match_substring_regex(pieces, _MARKED)
        word = pc.if_else(marked, pc.utf8_rtrim(pieces, _MARKS), pieces)
        tail = pc.if_else(marked, pc.replace_substring_regex(pieces, r"^\p{L}+", ""), "")
        first = pc.if_else(broken, _BEHIND + "\n", word)
        second = pc.if_else(broken, pc.utf8_slice_codeunits(pieces, 1), tail)
        second = pc.if_else(pc.equal(second, ""), "", pc.binary_join_element_wise(_BEHIND, second, ""))
        units = pc.dictionary_encode(pa.concat_arrays([first, second]))
        if len(self.known) > self.words:
            self.known = Units()
        at = self.known.find(units.dictionary)
        if (at < 0).any():
            self._learn(units.dictionary.filter(pa.array(at < 0)).to_pylist())
            at = self.known.find(units.dictionary)
        at = at[units.indices.to_numpy(zero_copy_only=False)].reshape(2, -1).T
        sizes = self.known.sizes[at]
        ids = self.known.ids[ranges(self.known.starts[at].ravel(), sizes.ravel())]
        sizes = sizes.sum(axis=1)
        return ids, np.cumsum(sizes) - sizes, sizes

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the number of each. A line break put before each text marks its first word; its id goes again."""
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n"), " ")
        lists = pc.list_slice(lists, 1)  # an empty piece stands before the first
        flat = pc.dictionary_encode(pc.list_flatten(lists))
        table, starts, sizes = self._found(flat.dictionary)
        which = flat.indices.to_numpy(zero_copy_only=False)
        sizes = sizes[which]
        ids = table[ranges(starts[which], sizes)]
        bounds = _bounds(lists, sizes)
        # A text begins with its line break's ids.
        gone = bounds[:-1]
        keep = np.ones(len(ids), bool)
        for n in range(len(self.line_break)):
            keep[gone + n] = False
        return ids[keep], np.diff(bounds) - len(self.line_break)

    def _careful(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts with odd white space: cut only between a space's two other characters; pieces with white space inside go to the library alone."""
        for _ in range(2):  # a character may stand behind one cut and before the next
            texts = pc.replace_substring_regex(texts, _SAFE_CUT, rf"\1{_CUT}\2")
        lists = pc.split_pattern(pc.binary_join_element_wise(_FIRST, texts, ""), _CUT)
        flat = pc.dictionary_encode(pc.list_flatten(lists))
        pieces = flat.dictionary
        first = pc.starts_with(pieces, _FIRST)
        alone = pc.or_(first, pc.match_substring_regex(pieces, f"[{_SPACES}]"))
        asked = pc.if_else(first, pc.utf8_slice_codeunits(pieces, 1), pc.binary_join_element_wise(" ", pieces, "")).filter(alone)
        ids, sizes = self._whole(asked.to_pylist())
        alone = alone.to_numpy(zero_copy_only=False)
        table, begins, lengths = self._found(pieces.filter(pa.array(~alone)))
        start, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        start[alone], size[alone] = np.cumsum(sizes) - sizes, sizes
        start[~alone], size[~alone] = len(ids) + begins, lengths
        which = flat.indices.to_numpy(zero_copy_only=False)
        return np.concatenate([ids, table])[ranges(start[which], size[which])], np.diff(_bounds(lists, size[which]))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row of the first text, its and the following texts' ids joined, number of ids of each), in blocks. Null texts have no ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        chars = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(chars, (chars[at - 1] if at else 0) + self.chars, "right")))
            some = texts.slice(at, end - at)
            whole = pc.match_substring_regex(some, f"[{_CUT}{_FIRST}{_BEHIND}]")
            for t in self.added:
                whole = pc.or_(whole, pc.match_substring(some, t))
            odd = pc.and_not(pc.match_substring_regex(some, _ODD_SPACE), whole)
            kind = whole.to_numpy(zero_copy_only=False) + 2 * odd.to_numpy(zero_copy_only=False)
            parts = [(np.flatnonzero(kind == k), *way(some.filter(pa.array(kind == k)))) for k, way in enumerate((self._cut, lambda t: self._whole(t.to_pylist()), self._careful)) if (kind == k).any()]
            row, sizes = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
            back = np.argsort(row, kind="stable")
            ids = np.concatenate([p[1] for p in parts])
            if len(parts) > 1:
                ids = ids[ranges((np.cumsum(sizes) - sizes)[back], sizes[back])]
            yield at, ids, sizes[back]
            at = end
            del ids, sizes, some, parts
            give_back()


def _bounds(lists: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Where the ids of each list of pieces begin and end, by the number of each piece's ids."""
    pieces = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(pieces)])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, words: int = CACHE_WORDS, chars: int = BLOCK_CHARS) -> Encoder:
    """One per worker process and vocabulary file, within the bounds last asked for."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].words, _ENCODERS[path].chars = words, chars
    return _ENCODERS[path]


def default_vocabulary() -> str:
    """The vocabulary file of the registered queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
