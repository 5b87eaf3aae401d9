"""BPE encoding and decoding by dynamic programming over prefixes.

For a BPE vocabulary every prefix of a word has exactly one last token in its encoding: the one
token that ends there, whose rest is encoded with a last token that may stand beside it. Matching
tokens at each end come from a suffix automaton (an Aho-Corasick automaton over the tokens, whose
failure links lead through all tokens that are suffixes), longest first; two tokens may stand
beside each other if merging their join would not have cut differently. Following the back
pointers from the end of the word gives the exact ids.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from os.path import commonprefix

import ahocorasick
import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import slices

#: Distinct words, and distinct pieces, whose ids a worker remembers at a time, and as many from
#: before; beyond it forgets and goes on. A new piece of known words costs little.
REMEMBERED_WORDS = 150_000
REMEMBERED_PIECES = 110_000
#: Characters of the longest of them: longer ones hardly come again, and have no bound in memory.
REMEMBERED_LENGTH = 40
#: Pairs of tokens whose compatibility a task remembers at a time.
REMEMBERED_PAIRS = 500_000


# Unicode's white space. str.split() takes four control characters for it as well.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_WHITE_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_cut = re.compile(f"[^{WHITE_SPACE}]+").findall
# The accented letters of Latin-1, which are in composed form as they are.
SMALL = "\xdf-\xf6\xf8-\xff"
_is_plain = re.compile(f"[\x00-\x7f\xc0-\xd6\xd8-\xde{SMALL}]*").fullmatch


def byte_letters() -> dict[int, str]:
    """The usual letters for bytes: printable Latin-1 stands for itself, the others move up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(moved)}


class WordBpe:
    """Tokenizer read from a ``tokenizers`` file: BPE with an end-of-word mark over byte letters,
    NFC, white space runs as one space, lower case, words cut out by a pattern."""

    def __init__(self, spec_json: str):
        spec = json.loads(spec_json)
        model = spec["model"]
        self.mark: str = model["end_of_word_suffix"]
        self.id_of: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # What all special tokens begin with.
        self.special_begin = commonprefix(list(self.special)) if self.special else "\0\0"
        self.text_of = {i: t for t, i in self.id_of.items()} | {i: t for t, i in self.special.items()}
        # What is not ASCII is normalized and cut by the file's own rules, with the Unicode tables
        # that the library has.
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        whole = json.dumps(spec | {"pre_tokenizer": split, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        rules = tokenizers.Tokenizer.from_str(whole)
        self.normalize, self.pre_tokenize = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        letters = split["pattern"]["Regex"].replace(r"\p{L}", f"a-z{SMALL}").replace(r"\p{N}", "0-9").replace(r"\s", "\t-\r ")
        self.plain_words = re.compile(letters).findall
        self.special_of = (
            re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")").split
            if self.special else lambda text: [text]
        )
        self.letters = byte_letters()
        # A merged token's halves, and the rank at which a pair merges.
        self.rank = {tuple(pair): k for k, pair in enumerate(model["merges"])}
        self.halves: dict[str, tuple[str, str]] = {}
        for a, b in self.rank:
            self.halves.setdefault(a + b, (a, b))
        self.automaton = self._suffix_automaton()
        self.pairs: dict[int, bool] = {}

    # -- words -------------------------------------------------------------------------------

    @staticmethod
    def pieces(text: str) -> list[str]:
        """What stands between white space."""
        if any(map(text.__contains__, NOT_WHITE_SPACE)):
            return _cut(text)
        return text.split()

    def words(self, part: str) -> list[str]:
        """Words of a piece without special tokens, normalized."""
        if part.isascii() or _is_plain(part):
            return self.plain_words(part.lower())
        return [word for word, _ in self.pre_tokenize(self.normalize(part))]

    def parts(self, piece: str) -> list[int | str]:
        """Ids of special tokens, which are cut out first, and words."""
        if self.special_begin not in piece:
            return self.words(piece)
        found: list[int | str] = []
        for k, part in enumerate(self.special_of(piece)):
            found += [self.special[part]] if k % 2 else self.words(part)
        return found

    # -- one word ----------------------------------------------------------------------------

    def _suffix_automaton(self) -> ahocorasick.Automaton:
        """Every token of two symbols or more under its symbols; single symbols match anywhere. The mark
        of a token that ends a word is one symbol."""
        automaton = ahocorasick.Automaton()
        for token, number in self.id_of.items():
            ends = token.endswith(self.mark) and len(token) > len(self.mark)
            symbols = token[: -len(self.mark)] + "\0" if ends else token
            if len(symbols) > 1:
                automaton.add_word(symbols, (number, len(symbols)))
        automaton.make_automaton()
        return automaton

    def _compatible(self, left: str, right: str) -> bool:
        """May ``right`` follow ``left``? Undo the merges of both, latest first: at no step may
        the pair at the border have merged before the merge that is being undone. Equal merges
        run from left to right, so at equal rank the border goes before ``right``'s merge."""
        limit = len(self.rank)
        while True:
            if self.rank.get((left, right), limit) < limit:
                return False
            made_left, made_right = self.halves.get(left), self.halves.get(right)
            if made_left is None and made_right is None:
                return True
            rank_left = self.rank[made_left] if made_left else -1
            rank_right = self.rank[made_right] if made_right else -1
            if rank_left > rank_right:
                limit, left = rank_left, made_left[1]
            else:
                limit, right = rank_right + 1, made_right[0]

    def encode_word(self, word: str) -> list[int]:
        """Exact ids of one word (already normalized)."""
        if word.isascii() and word.isprintable():
            text = word + "\0"
        else:
            text = "".join(map(self.letters.__getitem__, word.encode("utf-8"))) + "\0"
        whole = self.id_of.get(text[:-1] + self.mark)
        if whole is not None:
            return [whole]  # the longest match that ends there, with nothing before it
        n, pairs = len(text), self.pairs
        # Where nothing longer fits, the last token is the single symbol.
        last = [-1, *map(self.id_of.get, text)]
        lengths = [1] * (n + 1)
        # Matches come by their end, at one end the longest first: the first that fits is the one.
        found = 0
        for at, (token, length) in self.automaton.iter(text):
            end = at + 1
            if end == found or end == n - 1:  # the mark belongs to the last letter
                continue
            start = end - length
            if start:
                before = last[start]
                pair = before << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= REMEMBERED_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self._compatible(self.text_of[before], self.text_of[token])
                if not fits:
                    continue
            last[end], lengths[end], found = token, length, end
        ids, end = [], n
        while end:
            ids.append(last[end])
            end -= lengths[end]
        ids.reverse()
        return ids

    # -- texts -------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text):
            for part in self.parts(piece):
                ids.extend((part,) if isinstance(part, int) else self.encode_word(part))
        return ids

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces (the file names no decoder)."""
        return " ".join([self.text_of[i] for i in ids])


class _Remembered(dict):
    """What was made of the keys seen lately. When it is full, it becomes the older half, from which
    keys that are seen again come back; the others are forgotten at the next time."""

    def __init__(self, make, most):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if isinstance(key, str) and len(key) > REMEMBERED_LENGTH:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def remembering(bpe: WordBpe) -> _Remembered:
    """Piece -> (ids as bytes, decoded text), by way of its words."""
    def of_word(part: int | str) -> tuple[bytes, str]:
        ids = [part] if isinstance(part, int) else bpe.encode_word(part)
        return array("i", ids).tobytes(), bpe.decode(ids)

    words = _Remembered(of_word, REMEMBERED_WORDS)

    def of_piece(piece: str) -> tuple[bytes, str]:
        parts = bpe.parts(piece)
        if len(parts) == 1:
            return words[parts[0]]
        found = [words[part] for part in parts]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    return _Remembered(of_piece, REMEMBERED_PIECES)


class _Shared:
    """The vocabulary file, and in each worker process what is made of it, once for all its tasks."""

    def __init__(self, spec_json: str):
        self.spec_json, self.pieces, self.known = spec_json, WordBpe.pieces, None

    def __reduce__(self):
        return _Shared, (self.spec_json,)

    def remembered(self) -> _Remembered:
        if self.known is None:
            self.known = remembering(WordBpe(self.spec_json))
        return self.known


def encode_decode(
    documents: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: the id, ``ids`` (array of int) and ``decoded``.

    ``decoded`` is decoded from the ids. Null and empty texts have no ids and an empty decoded
    text; null ids and repeated rows are kept; an empty table gives an empty result; other columns
    are not read. The vocabulary file is read on the driver and broadcast (a few MB, fixed by the
    file). The work is per row, texts are never cut: no shuffle.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = documents.sparkSession.sparkContext.broadcast(_Shared(file.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What earlier stages left in this worker goes back first.
        gc.collect()
        pa.default_memory_pool().release_unused()
        known, pieces = spec.value.remembered(), spec.value.pieces
        for batch, _, _ in slices(batches):
            coded, decoded = [], []
            for text in batch.column("text").to_pylist():
                found = [known[piece] for piece in pieces(text or "")]
                coded.append(b"".join([f[0] for f in found]))
                decoded.append(" ".join([f[1] for f in found if f[0]]))
            offsets = np.cumsum([0, *map(len, coded)]) // 4
            ids = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), ids, pa.array(decoded, pa.string())], ["id", "ids", "decoded"]
            )

    read = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    out = read.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
