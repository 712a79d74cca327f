"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are themselves one token of the vocabulary. Which vocabulary strings encode alone as
exactly that one token is proved once per process, by running the merges over each of them; a pre-token among
them counts 1 without any merging, and only the rest is merged. Counts are those of the library on whole texts.

Texts are cut at single blanks first, which is always a boundary of byte-level pre-tokens unless white space
touches the blank on both sides; such texts are pre-tokenised whole. Counts of pieces are remembered in a
bounded table that is emptied when it is full, which changes no result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusaudit.llm.common import strings

#: Pieces remembered per Python worker (about 60 MB).
REMEMBERED = 300_000
#: White space on both sides of a blank, or a run at the end: the runs are no longer cut at each blank.
_RUN = re.compile(r"\s (?:\s|\Z)")


def cuts_at_blanks(text: str) -> bool:
    """Whether each blank of the text starts a pre-token, so that pieces can be encoded one by one."""
    return _RUN.search(text) is None


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: How byte-level pre-tokenizers cut text (fixed value, public with the vocabulary).
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below this, letters and digits are the same in every version of Unicode; other text is cut by the library.
_STABLE = "\u0250"
#: The commonest form of a piece: letters (Latin, stable as above), perhaps a run of marks.
_SIMPLE = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ɏ]+)([.,;:!?*&%#$]*)")


class ByteLevel:
    """Pre-tokens of a byte-level BPE tokenizer, and the tokens of one pre-token."""

    def __init__(self, tokenizer):
        self.pre, self.model = tokenizer.pre_tokenizer, tokenizer.model
        letters = _byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})
        self.bytes = {c: b for b, c in letters.items()}
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        #: vocabulary strings proved to encode alone as their one token, as they stand in texts
        self.whole = {}
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            if [t.id for t in self.model.tokenize(token)] == [i]:
                try:
                    self.whole[self._text(token)] = i
                except UnicodeDecodeError:
                    pass  # part of a character: never a pre-token

    def _text(self, token: str) -> str:
        return bytes(map(self.bytes.__getitem__, token)).decode()

    def pretokens(self, text: str) -> list[str]:
        if text.isascii() or max(text) < _STABLE:
            return _CUT.findall(text)
        return [self._text(p) for p, _ in self.pre.pre_tokenize_str(text)]

    def merged(self, pretoken: str):
        """Tokens of a pre-token by the merges of the model."""
        if pretoken[1:].isalpha() and pretoken.isascii():
            return self.model.tokenize(pretoken.replace(" ", "Ġ"))
        return self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.letters))


class Pieces(dict):
    """Values of ' ' + piece: the sum of those of its pre-tokens, from a table or by merging. Emptied when full."""

    def __init__(self, level: ByteLevel, whole: dict, merged: Callable, zero):
        super().__init__()
        self.level, self.whole, self.merged, self.zero = level, whole, merged, zero
        self.marks: dict[str, object] = {}

    def value(self, text: str):
        """Value of any text without special strings."""
        out = self.zero
        for p in self.level.pretokens(text):
            out += self.whole.get(p) or self.merged(p)
        return out

    def __missing__(self, piece: str):
        simple = _SIMPLE.fullmatch(piece)
        if simple is None:
            value = self.value(" " + piece)
        elif simple[2]:
            word, marks = simple.groups()
            if marks not in self.marks:
                if len(self.marks) >= REMEMBERED:
                    self.marks.clear()
                self.marks[marks] = self.value(marks)
            value = self[word] + self.marks[marks]
        else:
            value = self.whole.get(" " + piece) or self.merged(" " + piece)
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = value
        return value


class ByteLevelCounter:
    """Counts for byte-level BPE without normaliser; special strings in texts count one, as by default."""

    def __init__(self, tokenizer):
        self.level = ByteLevel(tokenizer)
        self.pieces = Pieces(self.level, dict.fromkeys(self.level.whole, 1), lambda p: len(self.level.merged(p)), 0)

    def _segment(self, text: str) -> int:
        if not text or not cuts_at_blanks(text):
            return self.pieces.value(text)
        first, *rest = text.split(" ")
        return self.pieces.value(first) + sum(map(self.pieces.__getitem__, rest))

    def __call__(self, text: str) -> int:
        special = self.level.special
        if special is None or special.search(text) is None:
            return self._segment(text)
        parts = special.split(text)
        return len(parts) - 1 + sum(map(self._segment, parts))


_COUNTERS: dict[str, object] = {}


def counter(path: str):
    """The function that counts the tokens of a text, for a .json or .model file; one per process."""
    if path not in _COUNTERS:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = lambda text: len(model.encode(text))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _COUNTERS[path] = ByteLevelCounter(tokenizer) if is_byte_level(tokenizer) else (lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids))
    return _COUNTERS[path]


def is_byte_level(tokenizer) -> bool:
    """Whether the shortcut holds: BPE over byte-level pre-tokens, nothing normalised, plain added tokens."""
    spec = json.loads(tokenizer.to_str())
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    return (
        spec["normalizer"] is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and model["type"] == "BPE"
        and not model.get("dropout")
        and plain
    )


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more tokens than ``limit``).

    Row-local: no shuffle, and no state but the bounded table of pieces. A null text counts as empty (0 bytes,
    0 tokens), a null id stays null, repeated rows give repeated rows, an empty table an empty result. Texts are
    never cut. ``tokenizer`` is a path every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            texts = strings(batch, text_col)
            n = [count(t) for t in texts]
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
