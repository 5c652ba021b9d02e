"""SentencePiece ids of whole texts and back, each distinct marked word of a batch segmented once.

White space is a marker that begins a word, and no piece of the model has a marker behind
another character or a newline beside anything: so no merge crosses the place before a run of
markers or either side of a newline. A batch of texts is cut there, its distinct words make a
table that the library segments (a row a word), and ids and decoded text are taken back by
position. `check_model` refuses models for which the cut would change an id.

Words aren't joined back by a shuffle: the words of a corpus are several times its bytes once
a document and a place stand beside each. A batch has texts of CHARACTERS together, or one text.

Defined cases: null and empty texts have no ids and decode to an empty text; a marker that
stands in a text itself is white space; repeated rows, null ids and rows of all other columns
are kept, but for columns named `ids` or `decoded` (in any case), which are replaced; texts of
any length are whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

MARK = "▁"
CHARACTERS = 16_000_000
SPLIT = "\x1f"
#: Words with the white space before them, white space before a newline or at the end, and newlines.
_WORDS = re.compile(" *[^ \n]+| +|\n").findall


@functools.lru_cache(maxsize=2)
def loaded(path: str):
    """The library's processor; a Python worker keeps it for its next task."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(processor)
    return processor


def check_model(processor) -> None:
    """Raise if a piece crosses a cut, or texts are changed before they are segmented."""
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if re.search(f"[^{MARK}]{MARK}", piece) or ("\n" in piece and piece != "\n"):
            raise ValueError(f"piece {i} of the model crosses white space")
    for probe in ("  a  b  ", "ﬁ Ａ é", " \t"):
        if processor.decode(processor.encode(probe)) != probe:
            raise ValueError("the model changes texts before it segments them")


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All texts' words, one after the other, and where each text's begin and the last's end; some may be empty."""
    marked = [" " + t.replace(MARK, " ") if t else "" for t in texts]
    # runs of markers stay together, which the plain split can't do
    odd = {i: _WORDS(t) for i, t in enumerate(marked) if "  " in t or SPLIT in t}
    plain = ["" if i in odd else t.replace("\n", f"{SPLIT}\n{SPLIT}").replace(" ", f"{SPLIT} ") for i, t in enumerate(marked)]
    lists = pc.split_pattern(pa.array(plain, pa.large_string()), SPLIT)
    if not odd:
        return lists.flatten(), lists.offsets.to_numpy()
    parts, counts, last = [], np.diff(lists.offsets.to_numpy()), 0
    for i, words in odd.items():
        parts += [lists.slice(last, i - last).flatten(), pa.array(words, pa.large_string())]
        counts[i], last = len(words), i + 1
    return pa.concat_arrays([*parts, lists.slice(last).flatten()]), np.concatenate([[0], counts.cumsum()])


def segment(processor, words: list[str]) -> tuple[pa.Array, pa.Array]:
    """Ids and decoded text of distinct words; a space is a marker, an empty word has no ids."""
    marked = [w[:1] == " " for w in words]
    # the library marks a text's beginning: a marked word goes without its first marker; one that
    # has none follows a newline, whose id and the beginning's marker are taken away again
    ids = processor.encode([w[1:] if m else "\n" + w for w, m in zip(words, marked)], num_threads=1)
    alone = [processor.piece_to_id(MARK)]
    ids = [(i or alone) if m else i[2:] for i, m in zip(ids, marked)]
    texts = processor.decode(ids, num_threads=1)  # which drops a first marker
    return pa.array(ids, pa.list_(pa.int32())), pa.array([" " + t if m else t for t, m in zip(texts, marked)], pa.large_string())


def encode_texts(processor, texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """Ids and decoded text of whole texts, from a table of their distinct words."""
    words, bounds = split(texts)
    coded = words.dictionary_encode()
    ids, decoded = segment(processor, coded.dictionary.to_pylist())
    placed = ids.take(coded.indices)
    offsets = placed.offsets.to_numpy()[bounds] - placed.offsets[0].as_py()
    _, at, characters = decoded.take(coded.indices).buffers()
    at = np.frombuffer(at, "<i8", len(words) + 1)[bounds] if len(words) else np.zeros(len(bounds), "<i8")
    whole = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), characters)
    whole = pc.utf8_slice_codeunits(whole, start=1).cast(pa.string())  # without the beginning's marker
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), placed.flatten()), whole


def runs(texts: list) -> list[tuple[int, int]]:
    """Ranges of texts of CHARACTERS together at most, or of one text."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size + n > CHARACTERS and i > first:
            out.append((first, i))
            first, size = i, 0
        size += n
    return [*out, (first, len(texts))]


def encode_documents(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with `ids` (array<int>) and `decoded` (what the ids decode to); no shuffle. keep: columns that go on, all by default."""

    def make():
        processor = loaded(model)

        def own(texts: list) -> list:
            made = [encode_texts(processor, texts[a:b]) for a, b in runs(texts)]
            return [pa.concat_arrays(column) for column in zip(*made)]

        return own

    return map_texts(docs, docs.columns if keep is None else keep, text, [("ids", "array<int>"), ("decoded", "string")], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
