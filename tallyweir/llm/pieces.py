"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of a model that splits at white space holds a marker (U+2581) after another character, so a piece never
crosses from one marked word into the next. A text is then its marked words in a row. A batch's texts are cut into words
as one Arrow array, which is dictionary-encoded: that is the table of its distinct words. Each of them is segmented once:
the words with one marker go to the library side by side, and the pieces that begin with a marker show where each word
begins; others go word by word. The ids are joined back by position: the table's lists of ids are taken by the words'
indices. Decoding works on the same table: a word's decoded text is its pieces' text, and byte pieces of one character
stay inside one word.

Defined results: a null text is empty and has no ids (0 tokens, hashes of the empty string); equal texts give equal
rows; rows and their order are kept, so repeated rows are repeated; a very long text is a batch of its own; extra columns
pass through `encode`, and an output column replaces an input column of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, flat_utf8, held_by_worker, sliced, trim

MARK = "▁"
#: Words that went to the library by themselves, and that a worker keeps; of so many characters at most.
TABLE_ENTRIES, LONGEST_KEPT = 20_000, 64
#: Bytes of words that go to the library side by side: its time grows faster than their number.
SIDE_BY_SIDE = 1 << 13
#: Bytes of text in a batch that has a table of its own.
BATCH_BYTES = 2 << 20
SPACE = 32


@dataclass
class Words:
    """Distinct words: their ids in a row and where each word's begin, these as texts ended by commas, and the decoded texts."""

    ids: np.ndarray
    starts: np.ndarray
    joined: pa.Array
    decoded: pa.Array


class ChunkTable(dict):
    """The library, and the entries of words that went to it by themselves: word, with spaces for its markers -> (ids, decoded text)."""

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        super().__init__()
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.entries = entries
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.normal = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.split_ok = self.normal and self._is_identity()
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.decimal = pa.array([f"{i}," for i in range(len(pieces))], pa.large_string())

    def _is_identity(self) -> bool:
        """Whether the model's normaliser only swaps spaces for markers and puts one marker first."""
        probe = "a  b\tc\nÅﬁ① é 　x "
        return self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)

    def segmented(self, word: str) -> tuple[list[int], str]:
        """One word's entry, by the library, which puts a marker first itself."""
        if (entry := self.get(word)) is None:
            ids = self.sp.encode(word[1:], add_bos=False, add_eos=False) if len(word) > 1 else [self.sp.piece_to_id(MARK)]
            rest = word.lstrip(" ")
            entry = ids, word[: len(word) - len(rest)] + self.sp.decode(ids).lstrip(" ") if rest else word
            if len(word) <= LONGEST_KEPT:
                if len(self) >= self.entries:
                    self.clear()
                self[word] = entry
        return entry

    def side_by_side(self, text: str, n: int) -> np.ndarray | None:
        """The ids of n words in a row, each after one space, if each word's begin with a marker and decode to the word."""
        ids = self.sp.encode(text[1:], add_bos=False, add_eos=False)
        found = np.array(ids, np.int32)
        return found if int(self.marked[found].sum()) == n and self.sp.decode(ids) == text[1:] else None

    def words(self, table: pa.Array) -> tuple[Words, np.ndarray]:
        """The entries of distinct words, and each word's place among them."""
        flat, offsets = flat_utf8(table)
        n = len(table)
        second = np.append(flat, np.uint8(SPACE))[np.minimum(offsets[:-1] + 1, len(flat))]
        plain = (np.diff(offsets) > 1) & (second != SPACE)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        ids, sizes, back = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
        own_flat, own = flat_utf8(table.filter(pa.array(plain)))
        a, many = 0, len(own) - 1
        while a < many:
            b = max(a + 1, int(np.searchsorted(own, own[a] + SIDE_BY_SIDE, "right")) - 1)
            text = own_flat[own[a] : own[b]].tobytes().decode()
            found = self.side_by_side(text, b - a)
            if found is not None:
                first = np.flatnonzero(self.marked[found])
                ids.append(found)
                sizes.append(np.diff(np.append(first, len(found))))
                back.append(pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(own[a : b + 1] - own[a]), pa.py_buffer(text.encode())))
            else:
                self._one_by_one([own_flat[own[i] : own[i + 1]].tobytes().decode() for i in range(a, b)], ids, sizes, back)
            a = b
        self._one_by_one(table.filter(pa.array(~plain)).to_pylist(), ids, sizes, back)
        flat_ids, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        digits, at = flat_utf8(self.decimal.take(pa.array(flat_ids)))
        joined = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at[starts]), pa.py_buffer(np.ascontiguousarray(digits)))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        return Words(flat_ids, starts, joined, pa.concat_arrays(back) if back else pa.array([], pa.large_string())), place

    def _one_by_one(self, words: list[str], ids: list, sizes: list, back: list) -> None:
        made = [self.segmented(w) for w in words]
        ids.append(np.fromiter(chain.from_iterable(e[0] for e in made), np.int32))
        sizes.append(np.array([len(e[0]) for e in made], np.int64))
        back.append(pa.array([e[1] for e in made], pa.large_string()))

    def encoded(self, texts: pa.Array) -> Encoded:
        """All texts of a batch."""
        held = texts.to_pylist() if not self.split_ok or self._has_marks(texts) else ()
        whole = [i for i, t in enumerate(held) if t and (not self.split_ok or MARK in t or "\0" in t)]
        flat, offsets = flat_utf8(texts)
        lengths = np.diff(offsets)
        taken = np.ones(len(flat), bool)
        for i in whole:
            taken[offsets[i] : offsets[i + 1]] = False
        lengths[whole] = 0
        # each text with a space before it, and so each word with its own; without those that go to the library whole
        some = lengths > 0  # an empty text has no words
        starts = np.concatenate([[0], np.cumsum(lengths + some)])
        first = starts[:-1][some]
        data = np.full(starts[-1], SPACE, np.uint8)
        place = np.ones(len(data), bool)
        place[first] = False
        data[place] = flat[taken] if whole else flat
        blank = data == SPACE
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[first] = True
        words_at = np.flatnonzero(begins)
        words = pa.LargeStringArray.from_buffers(len(words_at), pa.py_buffer(np.append(words_at, len(data)).astype(np.int64)), pa.py_buffer(data))
        table = words.dictionary_encode()
        entries, at = self.words(table.dictionary)
        return Encoded(self, texts, entries, at[table.indices.to_numpy()], np.searchsorted(words_at, starts), whole)

    def _has_marks(self, texts: pa.Array) -> bool:
        """Whether a text has a marker or a NUL of its own."""
        data = flat_utf8(texts)[0].tobytes()
        return MARK.encode() in data or b"\0" in data

    def encode_decode(self, text: str) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the decoded text."""
        made = self.encoded(pa.array([text], pa.string()))
        (joined,), (back,) = made.joined(), made.decoded()
        return bytes(joined).decode(), int(made.counts()[0]), bytes(back).decode()


class Encoded:
    """A batch's texts as indices of its distinct words."""

    def __init__(self, table: ChunkTable, texts: pa.Array, words: Words, indices: np.ndarray, of_text: np.ndarray, whole: list[int]):
        self.n, self.words, self.indices, self.of_text = len(texts), words, indices, of_text
        self.whole = {i: table.sp.encode(texts[i].as_py(), add_bos=False, add_eos=False) for i in whole}
        self.back = {i: table.sp.decode(ids).encode() for i, ids in self.whole.items()}
        self.ends = np.concatenate([[0], np.cumsum(np.diff(words.starts)[indices])])

    def counts(self) -> np.ndarray:
        """The number of ids of each text."""
        n = np.diff(self.ends[self.of_text])
        for i, ids in self.whole.items():
            n[i] = len(ids)
        return n

    def ids(self) -> np.ndarray:
        """The ids of all texts in a row."""
        lists = pa.LargeListArray.from_arrays(pa.array(self.words.starts), pa.array(self.words.ids))
        values = lists.take(pa.array(self.indices)).flatten().to_numpy(zero_copy_only=False)
        if not self.whole:
            return values
        at = self.ends[self.of_text]
        return np.concatenate([np.zeros(0, np.int32), *(np.array(self.whole[i], np.int32) if i in self.whole else values[at[i] : at[i + 1]] for i in range(self.n))])

    def _texts(self, of_word: pa.Array) -> Iterator[memoryview]:
        """The words' strings, joined by text."""
        flat, offsets = flat_utf8(of_word.take(pa.array(self.indices)))
        at, view = offsets[self.of_text].tolist(), memoryview(flat)
        return (view[a:b] for a, b in zip(at[:-1], at[1:]))

    def joined(self) -> Iterator[bytes | memoryview]:
        """Each text's ids, joined by commas."""
        for i, t in enumerate(self._texts(self.words.joined)):
            yield ",".join(map(str, self.whole[i])).encode() if i in self.whole else t[:-1]

    def decoded(self) -> Iterator[bytes | memoryview]:
        """The text that each text's ids decode to."""
        for i, t in enumerate(self._texts(self.words.decoded)):
            yield self.back[i] if i in self.whole else t[1:]


def chunk_table(model: str) -> ChunkTable:
    return held_by_worker("pieces", model, lambda: ChunkTable(model))


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the ids of each whole text (array of int) and the text that these ids decode to, unless decoded is None."""
    kept = bounded_batches(docs).drop(ids, *([decoded] if decoded else []))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for batch in batches:
            for part in sliced(batch, text, BATCH_BYTES):
                made = table.encoded(part.column(part.schema.get_field_index(text)))
                offsets = np.concatenate([[0], np.cumsum(made.counts())]).astype(np.int32)
                numbers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ids()))
                back = [pa.array([bytes(t).decode() for t in made.decoded()], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, numbers, *back], names=[*part.schema.names, ids, *([decoded] if decoded else [])])
        trim()

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row's whole text."""
    chosen = bounded_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        sha = lambda t: hashlib.sha256(t).hexdigest()
        for batch in batches:
            for part in sliced(batch, "text", BATCH_BYTES):
                made = table.encoded(part.column(1))
                columns = [pa.array(made.counts(), pa.int64()), pa.array(map(sha, made.joined()), pa.string()), pa.array(map(sha, made.decoded()), pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        trim()

    return chosen.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
