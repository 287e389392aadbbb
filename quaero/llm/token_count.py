"""Token counts by the whole-token shortcut.

The tokenizer is a SentencePiece BPE model whose white space is a marker at the
start of a piece.  :func:`prove` checks that no piece has the marker after
another character, so no merge crosses from a word into the space before the
next one: a text's tokens are those of its pre-tokens (spaces and the word after
them), each by itself.  It also encodes each marked vocabulary string alone and
keeps those that come out as one token.  A pre-token found there counts one; the
rest are merged by the library, once per word while a worker remembers it.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
LIMIT = 4096
#: Words and characters of a word that a worker remembers beyond the proven ones.
REMEMBERED, LONGEST = 400_000, 64
_PRE_TOKEN = re.compile(" *[^ ]+| +")


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove(path: str) -> frozenset[str]:
    """Words (without the space before them) that the model encodes as one token.

    Raises ValueError for a model that the shortcut doesn't fit: a piece with
    the marker inside, or white space that isn't kept as it is.
    """
    model = load(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if inner := [p for p in pieces if MARKER in p.lstrip(MARKER)]:
        raise ValueError(f"pieces go on after a space: {inner[:5]}")
    probe = "a  b c "
    if model.decode(model.encode(probe)) != probe or model.encode("  ") != model.encode(" " + " "):
        raise ValueError("the model changes white space")
    words = [p[1:] for p in pieces if p.startswith(MARKER) and len(p) > 1 and p[1] != MARKER]
    return frozenset(w for w, ids in zip(words, model.encode(words), strict=True) if len(ids) == 1)


class Counts(dict):
    """Tokens of a word after one space; words not yet known are merged by the library."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.whole = load(path), whole

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word))
        if len(word) <= LONGEST:
            if len(self) > len(self.whole) + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[word] = n
        return n

    def of(self, text: str) -> int:
        """Tokens of a text, without begin, end or added ones."""
        if not text:
            return 0
        if MARKER in text:  # the model can't tell it from a space
            return len(self.model.encode(text))
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        # every pre-token begins with a space, the first with the one that the model adds; a last space alone is one marker
        return sum(1 if p == " " else self[p[1:]] for p in _PRE_TOKEN.findall(" " + text))


_counters: dict = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``, by the SentencePiece model at ``path`` (on every machine).

    Whole texts are counted.  Null and empty texts have no bytes and no tokens;
    rows repeated or without doc_id each give a row; other columns are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches):
        counts = _counters.get(path) or _counters.setdefault(path, Counts(path, whole.value))
        for batch in batches:
            text = batch.column(1).fill_null("")
            n = [counts.of(t.as_py()) for t in text]
            size = pc.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
