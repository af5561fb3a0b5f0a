"""Alignment of two tokenizers over a corpus: which tokens of one go with which tokens of the other.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut them into groups, and all pairs of occurrences
within a group are linked. What counts for a pair of ids is in how many documents it is linked at all.

Most groups are one token against one token of the same bytes. For these an array says, for each id of the first
vocabulary, which id of the second has the same bytes; such pairs are counted in vectors as long as the vocabulary, and
never shuffled as pairs. Other pairs are counted once per chunk of documents before they are shuffled.

1. One narrow pass cuts texts into words on which both tokenizers agree to start anew, aligns each new word once, and
   writes one row per chunk of documents: the documents' own columns and digests, their words, and the words' pairs.
2. Vectors are summed per task and over tasks; other pairs are summed over chunks.
3. The sums of a chunk's pairs go back to the chunk in one row each, and the documents' figures are sums over their words.

Everything that travels with a chunk is bounded by the chunk; everything broadcast is as long as the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.bpe import ByteBpe, split_words
from webloom.llm.bytebpe import as_piece, model_bytes
from webloom.llm.common import stored, text_of

#: Words, and characters of their groups, in a worker's table; beyond it only the most used third of the words stays, of
#: which none is longer than ``LONG_WORD``.
CACHE_WORDS, CACHE_CHARS, LONG_WORD = 120_000, 20_000_000, 64
#: Groups with more links are multiplied out by how often they hold each id.
LONG_GROUP = 256
#: A chunk has at most so many documents, and ends with the document that brings it to so many bytes.
CHUNK_ROWS, CHUNK_BYTES = 1_000, 1_500_000

# Fixed value: the sentencepiece blank.
BLANK = "▁"
#: A word starts with a blank or line end that follows other text, or with one of these marks that follows a Latin letter.
MARKS, LETTER = ",.;:!?", "A-Za-zÀ-ÖØ-öø-ɏ"
WORD = re.compile(rf"[ \n{MARKS}](?:[^ \n{MARKS}]+|(?<=\s)[ \n]|(?<![{LETTER}])[{MARKS}])*")

FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Pieces:
    """A sentencepiece model that is given its leading blank with the text."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            # Field 3 is the normaliser, its field 3 the blank in front; a later value replaces an earlier one.
            model = f.read() + b"\x1a\x02\x18\x00"
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode()
                         for i, p in enumerate(pieces)]
        plain = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        # Where a byte and a piece spell the same, encoding uses the piece.
        self.id_of = {self.bytes_of[i]: i for i in sorted(plain, key=lambda i: not self.model.is_byte(i))}
        #: Whether no piece reaches across the start of a word and blanks are left alone, so that words can be encoded
        #: one by one.
        self.by_word = not any(re.search(rf"\S[ \n]|[{LETTER}][{MARKS}]", pieces[i].replace(BLANK, " ")) for i in plain) \
            and self.model.encode(" a  b\n") == [*self.model.encode(" a"), *self.model.encode("  b\n")]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, given their ends."""
    if not len(ends):
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _inside(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, … within each of consecutive stretches of these lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Rows:
    """Sparse rows: one after the other, values with their numbers of links."""

    def __init__(self, ends: np.ndarray, values: np.ndarray, links: np.ndarray):
        self.ends, self.values, self.links = ends, values, links

    @classmethod
    def of(cls, keys: np.ndarray, size: int, rows: int, weight: np.ndarray | None = None) -> Rows:
        """From keys ``row * size + value``, each standing for one link (or ``weight``)."""
        keys, back = np.unique(keys, return_inverse=True)
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, back, 1 if weight is None else weight)
        return cls(np.searchsorted(keys, np.arange(1, rows + 1) * size), keys % size, links)

    def __add__(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.ends, other.ends + len(self.values)]),
                    np.concatenate([self.values, other.values]), np.concatenate([self.links, other.links]))

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends

    def take(self, rows: np.ndarray) -> tuple[Rows, np.ndarray]:
        """Some rows, and their lengths."""
        starts = self.starts()[rows]
        length = self.ends[rows] - starts
        at = np.repeat(starts, length) + _inside(length)
        return Rows(np.cumsum(length), self.values[at], self.links[at]), length


class Words:
    """Aligned words, one after the other: numbers of tokens, groups and links, the groups' text, the linked pairs.

    ``same`` are links between tokens of the same bytes, by the id of the first; ``pairs`` are all others. A word that
    the tokens do not spell is ``bad``.
    """

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.characters = 0
        self.figures, self.bad, self.uses = np.zeros((0, 4), np.int64), np.zeros(0, bool), none
        self.same = self.pairs = Rows(none, none, none)

    def most_used(self, count: int) -> Words:
        """A table of the words that were used most; they soon come again."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:count])
        names, out = list(self.place), Words()
        keep = keep[[len(names[i]) <= LONG_WORD for i in keep.tolist()]] if len(keep) else keep
        out.place = {names[i]: n for n, i in enumerate(keep.tolist())}
        out.groups = [self.groups[i] for i in keep.tolist()]
        out.characters = sum(map(len, out.groups))
        out.figures, out.bad, out.uses = self.figures[keep], self.bad[keep], self.uses[keep]
        out.same, out.pairs = self.same.take(keep)[0], self.pairs.take(keep)[0]
        return out


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteBpe(byte_path), Pieces(piece_path)
        self.same = np.array([self.b.id_of.get(t, -1) for t in self.a.bytes_of], np.int64)
        self.length_a, self.length_b = (np.array([len(t) for t in x.bytes_of], np.int64) for x in (self.a, self.b))
        import sentencepiece

        ranks = {t: i for t, i in self.a.id_of.items() if self.a.sound[i]}
        self.proposed = np.array(sorted(ranks.values()), np.int64)
        self.proposer = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.words = Words()

    def split(self, text: str) -> list[str]:
        return WORD.findall(" " + text) if self.b.by_word else [" " + text]

    def known(self, words: set[str]) -> Words:
        """The table of words, with all of ``words`` in it."""
        if len(self.words.groups) > CACHE_WORDS or self.words.characters > CACHE_CHARS:
            self.rest()
        if new := [w for w in words if w not in self.words.place]:
            self._learn(new)
        return self.words

    def rest(self) -> None:
        """Keep only the words that are used most."""
        self.words = self.words.most_used(CACHE_WORDS // 3)

    def _learn(self, words: list[str]) -> None:
        of_a, of_b = self._tokens_a(words), self.b.encode(words)
        raw = [w.encode() for w in words]
        bad = np.zeros(len(words), bool)
        length = np.array([len(w) for w in raw], np.int64)
        for of, spell, sizes in ((of_a, self.a.bytes_of, self.length_a), (of_b, self.b.bytes_of, self.length_b)):
            count = np.array([len(x) for x in of], np.int64)
            flat = np.fromiter(chain.from_iterable(of), np.int64, count.sum())
            if (_sums(sizes[flat], np.cumsum(count)) == length).all() \
                    and b"".join(map(spell.__getitem__, flat.tolist())) == b"".join(raw):
                continue
            bad |= [b"".join(map(spell.__getitem__, x)) != w for x, w in zip(of, raw)]
        for i in np.flatnonzero(bad).tolist():
            of_a[i] = of_b[i] = []
        table = self.words
        table.place.update(zip(words, range(len(table.groups), len(table.groups) + len(words))))
        figures, groups, same, pairs = self._align(of_a, of_b)
        table.figures, table.bad = np.concatenate([table.figures, figures]), np.concatenate([table.bad, bad])
        table.uses = np.concatenate([table.uses, np.zeros(len(words), np.int64)])
        table.groups += groups
        table.characters += sum(map(len, groups))
        table.same, table.pairs = table.same + same, table.pairs + pairs

    def _tokens_a(self, words: list[str]) -> list[list[int]]:
        """Ids of the first vocabulary. Most words are one pre-token: a blank and letters."""
        parts = {w: split_words(w) for w in words if not (w[0] == " " and w[1:].isalpha())}
        different = [w for w in words if w not in parts]
        different += set().union(*parts.values()).difference(different)
        tokens = dict(zip(different, self._merged(different)))
        return [list(chain.from_iterable(map(tokens.__getitem__, parts[w]))) if w in parts else tokens[w] for w in words]

    def _merged(self, parts: list[str]) -> list[list[int]]:
        """Ids of pre-tokens. A sentencepiece model with the same tokens proposes them; where some merge would cross
        between two proposed neighbours, or a token is not what its own merges give, the merges are done one by one."""
        found = self.proposer.encode([as_piece(p.encode()) for p in parts], num_threads=1) if parts else []
        count = np.array([len(x) for x in found], np.int64)
        flat = self.proposed[np.fromiter(chain.from_iterable(found), np.int64, count.sum())]
        part = np.repeat(np.arange(len(parts)), count)
        fails = np.zeros(len(parts), bool)
        fails[part[~self.a.sound[flat]]] = True
        inside = np.flatnonzero(part[1:] == part[:-1])
        pairs, back = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        if len(pairs):
            fails[part[inside[~self.a.pairs_hold(pairs >> 32, pairs & 0xFFFFFFFF)[back]]]] = True
        flat, ends = flat.tolist(), np.cumsum(count).tolist()
        out = [flat[s:e] for s, e in zip([0, *ends], ends)]
        again = np.flatnonzero(fails).tolist()
        for i, ids in zip(again, self.a.encode_words([parts[i] for i in again])):
            out[i] = ids
        return out

    def _align(self, of_a: list[list[int]], of_b: list[list[int]]) -> tuple[np.ndarray, list[str], Rows, Rows]:
        """Groups and links of many words at once. Laid end to end both token lists have the same bytes, so that groups
        end at the offsets that both have."""
        n_a, n_b = (np.array([len(x) for x in of], np.int64) for of in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(of), np.int64, n) for of, n in ((of_a, n_a.sum()), (of_b, n_b.sum())))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        size_a, size_b = (np.bincount(np.searchsorted(cuts, e), minlength=len(cuts)) for e in (ends_a, ends_b))
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        word_of_a = np.repeat(np.arange(len(n_a)), n_a)
        word = word_of_a[start_a] if len(cuts) else np.zeros(0, np.int64)
        links = size_a * size_b
        n_groups = np.bincount(word, minlength=len(n_a))
        figures = np.stack([n_a, n_b, n_groups, _sums(links, np.cumsum(n_groups))], axis=1)

        name_a, name_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts = [f"{name_a[i]}|{name_b[j]}" if n == m == 1 else ",".join(name_a[i:i + n]) + "|" + ",".join(name_b[j:j + m])
                 for i, j, n, m in zip(start_a.tolist(), start_b.tolist(), size_a.tolist(), size_b.tolist())]
        ends = np.cumsum(n_groups).tolist()
        groups = [";".join(texts[s:e]) for s, e in zip([0, *ends], ends)]

        # One against one with the same bytes: known by the array alone. Long groups are multiplied out by counts.
        single = (links == 1) & (self.same[a[start_a]] == b[start_b]) if len(cuts) else np.zeros(0, bool)
        long = links > LONG_GROUP
        some = np.flatnonzero(~single & ~long)
        place, n = _inside(links[some]), np.repeat(some, links[some])
        width = len(self.length_b)
        code = a[start_a[n] + place // size_b[n]] * width + b[start_b[n] + place % size_b[n]]
        words, codes, weights = [word[single], word[n]], [a[start_a[single]] * width + b[start_b[single]], code], \
            [np.ones(single.sum(), np.int64), np.ones(len(code), np.int64)]
        for g in np.flatnonzero(long).tolist():
            x, k = np.unique(a[start_a[g]:start_a[g] + size_a[g]], return_counts=True)
            y, m = np.unique(b[start_b[g]:start_b[g] + size_b[g]], return_counts=True)
            codes.append((x[:, None] * width + y[None, :]).ravel())
            weights.append((k[:, None] * m[None, :]).ravel())
            words.append(np.full(len(codes[-1]), word[g]))
        words, codes, weights = (np.concatenate(x) for x in (words, codes, weights))
        alike = self.same[codes // width] == codes % width
        size = len(self.same)
        same = Rows.of(words[alike] * size + codes[alike] // width, size, len(n_a), weights[alike])
        pairs = Rows.of(words[~alike] * (size * width) + codes[~alike], size * width, len(n_a), weights[~alike])
        return figures, groups, same, pairs


@lru_cache(maxsize=1)
def load_aligner(byte_path: str, piece_path: str) -> Aligner:
    """One aligner per Python worker; it outlives tasks."""
    return Aligner(byte_path, piece_path)


def _texts_of(rows: Rows, row: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of documents' words, and the number of documents that hold each."""
    found, length = rows.take(row)
    values, back = np.unique(found.values, return_inverse=True)
    held = np.unique(np.repeat(doc, length) * len(values) + back) % max(len(values), 1)
    return values, np.bincount(held, minlength=len(values))


def chunk_columns(aligner: Aligner, texts: list[str]) -> dict[str, np.ndarray | list]:
    """Documents of a chunk as sparse rows of words, and its words as sparse rows of linked ids."""
    split = [aligner.split(t) if t else [] for t in texts]
    table = aligner.known(set().union(*split) if split else set())
    ids = np.fromiter(map(table.place.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
    np.add.at(table.uses, ids, 1)
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in split])
    spoilt = np.zeros(len(texts), bool)
    spoilt[doc[table.bad[ids]]] = True
    digests, at, groups = [], 0, table.groups
    for words, out in zip(split, spoilt.tolist()):
        mine = ids[at:at + len(words)].tolist()
        digests.append(sha256(";".join(map(groups.__getitem__, mine)).encode()).hexdigest() if mine and not out else "")
        at += len(words)
    use = ~spoilt[doc]
    key, times = np.unique(doc[use] * max(len(groups), 1) + ids[use], return_counts=True)
    doc, ids = key // max(len(groups), 1), key % max(len(groups), 1)
    ends = np.searchsorted(doc, np.arange(len(texts)), "right")
    chosen, words = np.unique(ids, return_inverse=True)
    figures = np.stack([_sums(times * table.figures[ids, k], ends) for k in range(4)], axis=1)
    inner = {"figures": figures.ravel(), "digests": "".join(digests), "spoken": [d != "" for d in digests],
             "ends": ends, "words": words, "times": times}
    out = {}
    for name, rows in (("same", table.same), ("pair", table.pairs)):
        values, held = _texts_of(rows, ids, doc)
        mine, _ = rows.take(chosen)
        inner |= {f"{name}_ends": mine.ends, f"{name}_at": np.searchsorted(values, mine.values), f"{name}_links": mine.links}
        out |= {f"{name}s": values, f"{name}_texts": held}
    return out | {"packed": pack(inner)}


INNER = pa.schema([(n, pa.list_(t)) for n, t in (
    ("figures", pa.int64()), ("spoken", pa.bool_()), ("ends", pa.int32()), ("words", pa.int32()), ("times", pa.int32()),
    ("same_ends", pa.int32()), ("same_at", pa.int32()), ("same_links", pa.int64()),
    ("pair_ends", pa.int32()), ("pair_at", pa.int32()), ("pair_links", pa.int64()))] + [("digests", pa.large_string())])


def pack(columns: dict[str, np.ndarray | list | str]) -> bytes:
    """What only Python reads of a chunk, as one compressed Arrow batch of one row."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, INNER, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array([columns[f.name]], f.type) for f in INNER], schema=INNER))
    return out.getvalue().to_pybytes()


def unpack(packed: bytes) -> dict[str, np.ndarray | str]:
    batch = pa.ipc.open_stream(packed).read_next_batch()
    return {f.name: batch.column(i)[0].as_py() if f.name == "digests" else batch.column(i).flatten().to_numpy(zero_copy_only=False)
            for i, f in enumerate(INNER)}


CHUNK_COLUMNS = "sames array<int>, same_texts array<int>, pairs array<bigint>, pair_texts array<int>, packed binary"


def _chunks(df: DataFrame, byte_path: str, piece_path: str, chunk_rows: int) -> DataFrame:
    """One row per chunk of ``df``, whose last column is the text: a key, the other columns' rows, ``chunk_columns``."""
    kept = T.StructType(df.schema.fields[:-1])
    schema = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("rows", T.ArrayType(kept)),
                           *T._parse_datatype_string(CHUNK_COLUMNS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        aligner, number = load_aligner(byte_path, piece_path), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            length = np.diff(np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[
                texts.offset:texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
            start = 0
            while start < len(texts):
                total = np.cumsum(length[start:start + chunk_rows])
                end = start + min(len(total), int(np.searchsorted(total, CHUNK_BYTES)) + 1)
                part = batch.slice(start, end - start)
                found = chunk_columns(aligner, part.column(part.num_columns - 1).to_pylist())
                own = target.field("rows").type.value_type
                columns = [part.column(i).cast(own.field(i).type) for i in range(own.num_fields)]
                rows = pa.StructArray.from_arrays(columns, fields=list(own)) if columns else pa.array([{}] * part.num_rows, own)
                arrays = [pa.array([f"{task}-{number}"]),
                          pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows, type=target.field("rows").type)]
                arrays += [pa.array([found[f.name]], type=f.type) for f in list(target)[2:]]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
                start, number = end, number + 1
        aligner.rest()

    return df.mapInArrow(run, schema)


def _same_counts(chunks: DataFrame, size: int) -> DataFrame:
    """``id, texts``: each task sums the vectors of its chunks in one as long as the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, texts = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            np.add.at(total, ids, texts)
        held = np.flatnonzero(total)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["id", "texts"])

    return chunks.select("sames", "same_texts").mapInArrow(run, "id bigint, texts bigint").groupBy("id").agg(
        F.sum("texts").alias("texts"))


def _figures(chunks: DataFrame, same_total, best, width: int, kept: T.StructType) -> DataFrame:
    """Documents with their figures, from chunks whose ``totals`` are the sums of their pairs, in order."""
    schema = T.StructType(kept.fields + [T.StructField(n, T.LongType()) for n in FIGURES]
                          + [T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        of_same, most = same_total.value, best.value
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)

                def column(name: str) -> pa.Array:
                    return one.column(one.schema.get_field_index(name))

                rows = column("rows").flatten()
                same, pairs, totals = (column(n).flatten().to_numpy().astype(np.int64) for n in ("sames", "pairs", "totals"))
                inner = unpack(column("packed")[0].as_py())
                texts = of_same[same]
                top = texts == most[same]
                at, links = inner["same_at"], inner["same_links"]
                word_best, word_sum = (_sums(links * x[at], inner["same_ends"]) for x in (top, texts))
                top = totals == most[pairs // width]
                at, links = inner["pair_at"], inner["pair_links"]
                word_best += _sums(links * top[at], inner["pair_ends"])
                word_sum += _sums(links * totals[at], inner["pair_ends"])
                words, times, ends = inner["words"], inner["times"].astype(np.int64), inner["ends"]
                counted = inner["figures"].reshape(-1, 4)
                arrays = [rows.field(k) for k in range(len(kept.fields))]
                arrays += [pa.array(counted[:, k]) for k in range(4)]
                arrays += [pa.array(_sums(times * x[words], ends)) for x in (word_best, word_sum)]
                at = np.cumsum(inner["spoken"]) * 64
                arrays.append(pa.array([inner["digests"][e - 64:e] if s else "" for s, e in zip(inner["spoken"], at.tolist())]))
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return chunks.mapInArrow(run, schema)


def pair_counts(totals: DataFrame, same: dict[int, int], same_to: np.ndarray, width: int) -> DataFrame:
    """The whole table of linked ids, ``a, b, texts``."""
    spark = totals.sparkSession
    vector = spark.createDataFrame([(a, int(same_to[a]), n) for a, n in same.items()], "a bigint, b bigint, texts bigint")
    return totals.select(F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "texts").unionByName(vector)


def align(df: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: list[str] | None = None,
          chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Figures per document, and the table ``a, b, texts`` of linked ids with the number of documents that link them.

    Documents keep their columns (or those of ``keep``; columns with the names of figures are replaced) and get
    ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of their first id, ties
    included), ``count_sum`` (counts over links) and ``groups_sha256``. Null and empty texts, and texts that one of the
    two vocabularies does not spell, have no tokens: zeros and an empty digest. Repeated rows count as documents of
    their own. An empty table gives empty tables.
    """
    spark = df.sparkSession
    added = {*FIGURES, "groups_sha256"}
    columns = [c for c in keep or df.columns if c not in added]
    plain = [f"c{i}" for i in range(len(columns))]  # names inside are the operator's own
    source = df.select(*[F.col(c).alias(p) for c, p in zip(columns, plain)], text_of(text).alias("whole text"))
    kept = T.StructType(source.schema.fields[:-1])
    chunks = stored(_chunks(source, byte_path, piece_path, chunk_rows), "chunks")
    aligner = load_aligner(byte_path, piece_path)
    size, width = len(aligner.same), len(aligner.length_b)
    same = {r["id"]: r["texts"] for r in _same_counts(chunks, size).collect()}  # at most the vocabulary
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "pair_texts")).alias("at", "p")).select(
        "chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.pair_texts").alias("texts"))
    totals = stored(pairs.groupBy("pair").agg(F.sum("texts").alias("texts")), "pairs")
    same_total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for a, n in same.items():
        same_total[a] = best[a] = n
    highest = totals.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("texts").alias("n"))
    for r in highest.collect():  # at most the vocabulary
        best[r["a"]] = max(best[r["a"]], r["n"])
    back = pairs.join(totals.withColumnRenamed("texts", "total"), "pair").groupBy("chunk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda x: x["total"]).alias("totals"))
    joined = chunks.drop("pair_texts", "same_texts").join(back, "chunk", "left").withColumn(
        "totals", F.coalesce("totals", F.array().cast("array<bigint>"))).drop("chunk")
    context = spark.sparkContext
    out = _figures(joined, context.broadcast(same_total), context.broadcast(best), width, kept)
    named = out.select(*[F.col(p).alias(c) for p, c in zip(plain, columns)], *FIGURES, "groups_sha256")
    return named, pair_counts(totals, same, aligner.same, width)
