"""BPE encoding and decoding by tree concatenation.

A text is cut at special tokens, normalised and split into pre-tokens; equal pre-tokens
of a task are encoded once. A text of more than PIECE code points isn't one task's work:
after normalisation it is halved, wherever the halves may fall, until no piece is longer; the
pieces are dealt out and encoded in parallel, and joined again two by two. Around a join the
pre-tokens are split again in a window that grows on the side that still disagrees, until
the first and the last pre-token of the window are those of the halves; what lies between is
encoded again.

A pre-token of more than LEAF symbols, or one that a cut went through, is joined in the same
manner one level below: the tokens around the join are encoded again in a growing window.
A token sequence is the encoding of its text exactly if every two neighbours encode to
themselves, so the join is done when the pairs at both ends of the window agree.

Vocabulary, merges, special tokens and word-end suffix come from the tokenizer file,
whose path is a parameter; nothing is trained. Decoding reads the ids back through the
vocabulary; this tokenizer file declares no decoder, so tokens are joined by spaces.

Defined results: null text counts as empty and encodes to no ids; repeated rows are each
returned; an empty table gives no rows; other columns are ignored. Of a very long text, only
normalising it and putting its result into one row are one task's work.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle_table


#: Code points of a text that are encoded without halving.
PIECE = 1 << 14
#: Symbols of a pre-token that are.
LEAF = 96
#: Code points in which a pre-token is looked for at first.
REACH = 32
#: Texts whose ids a task holds at once.
ROWS_AT_ONCE = 500
#: Distinct pre-tokens that a task remembers, and as many of those it met before these; of one met once only the ids, packed.
REMEMBERED = 250_000
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 62
# Fixed value: the split pattern of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the pattern comes to in lower-cased ASCII.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Combining marks up to this one are ordered alike by every version of Unicode in use.
LAST_OLD_MARK = "\u036f"
#: Beyond these, a text's characters are looked up one by one.
_LONG_ASSIGNED = regex.compile(r"[^\u0000-\u0557\u2010-\u2027\u20A0-\u20BF]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


@dataclass
class Part:
    """Normalised text, its ids, and whether these take the last pre-token to go on."""

    text: str
    ids: array
    open: bool


def halves(text: str) -> list[str]:
    """The text halved until no piece is longer than PIECE."""
    parts = 1
    while len(text) > parts * PIECE:
        parts *= 2
    return [text[len(text) * k // parts : len(text) * (k + 1) // parts] for k in range(parts)]


class TreeBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        #: Two ids in one number to rank and made id in one number.
        self.merges: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = self.vocab[a + b]
            self.merges[self.vocab[a] << ID_BITS | self.vocab[b]] = rank << ID_BITS | made
            self.parts.setdefault(made, (self.vocab[a], self.vocab[b]))
        symbols = byte_symbols()
        self.inner = [self.vocab[symbols[b]] for b in range(256)]
        self.final = [self.vocab[symbols[b] + self.suffix] for b in range(256)]
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Each id's one number, so that remembered pre-tokens share it.
        self.numbers = list(range(max(self.names) + 1))
        self.words: dict[str, tuple[tuple[int, ...], str, str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str, str]] = {}
        self.once: dict[str, bytes] = {}
        self.older_once: dict[str, bytes] = {}
        self.agreed: dict[tuple[int, int], bool] = {}
        self._library = None
        self._path = path
        self.joins = 0

    # -- one unsplit text ---------------------------------------------------------

    def _merge(self, tokens: list[int]) -> list[int]:
        """Merge from scratch: the lowest rank first, of equal ranks the leftmost."""
        tokens, merge = list(tokens), self.merges.get
        found, last = [], -1
        for t in tokens:
            found.append(merge(last << ID_BITS | t, NO_MERGE))
            last = t
        found[0] = NO_MERGE  # of each token, its merge with the one before
        while (best := min(found)) != NO_MERGE:
            i, made = found.index(best), best & ID_MASK
            tokens[i - 1] = made
            del tokens[i], found[i]
            if i > 1:
                found[i - 1] = merge(tokens[i - 2] << ID_BITS | made, NO_MERGE)
            if i < len(found):
                found[i] = merge(made << ID_BITS | tokens[i], NO_MERGE)
        return tokens

    def _symbols(self, tokens: list[int]) -> list[int]:
        out, stack = [], tokens[::-1]
        while stack:
            t = stack.pop()
            if t in self.parts:
                a, b = self.parts[t]
                stack += (b, a)
            else:
                out.append(t)
        return out

    def _agree(self, a: int, b: int) -> bool:
        known = self.agreed.get((a, b))
        if known is None:
            if len(self.agreed) >= REMEMBERED:
                self.agreed.clear()
            known = self.agreed[a, b] = self._merge(self._symbols([a, b])) == [a, b]
        return known

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        a = b = 1
        self.joins += 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            middle = self._merge(self._symbols(left[-a:] + right[:b]))
            left_agrees = a == len(left) or self._agree(left[-a - 1], middle[0])
            right_agrees = b == len(right) or self._agree(middle[-1], right[b])
            if left_agrees and right_agrees:
                return left[: len(left) - a] + middle + right[b:]
            a, b = (a if left_agrees else 2 * a), (b if right_agrees else 2 * b)

    def encode_unsplit(self, word: bytes, final: bool = True) -> list[int]:
        """Ids of one pre-token, or of the beginning of one."""
        symbols = list(map(self.inner.__getitem__, word))
        if final:
            symbols[-1] = self.final[word[-1]]
        if len(symbols) <= LEAF:
            return self._merge(symbols)
        parts = [self._merge(symbols[i : i + LEAF]) for i in range(0, len(symbols), LEAF)]
        while len(parts) > 1:
            parts = [self._join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def _closed(self, ids: list[int]) -> list[int]:
        """Ids of a whole pre-token, of which those of a beginning are given."""
        symbols = self._symbols(ids[-1:])
        last = self._merge([*symbols[:-1], self.final[self.inner.index(symbols[-1])]])
        return self._join(ids[:-1], last) if len(ids) > 1 else last

    # -- whole texts --------------------------------------------------------------

    def _is_odd(self, text: str) -> bool:
        """Characters that Python's tables don't know yet, or marks whose order they know since: classes, cases and order are the tokenizer file's library's."""
        return bool(_LONG_ASSIGNED.search(text)) and any(unicodedata.category(c) == "Cn" or (c > LAST_OLD_MARK and unicodedata.combining(c)) for c in set(text))

    def _tokenizer(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def normal(self, text: str) -> str:
        """Normalise a text that holds no special token."""
        if text.isascii():
            return text.lower()
        if self._is_odd(text):
            return self._tokenizer().normalizer.normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        # One letter at a time where context would choose the letter's lower case.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def split_normal(self, text: str) -> list[str]:
        """The pre-tokens of normalised text."""
        if text.isascii():
            return _ASCII.findall(text)
        if self._is_odd(text):
            return [text[a:b] for a, b in self.spans(text)]
        return self.split.findall(text)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the pre-tokens of normalised text stand."""
        if text.isascii():
            return [m.span() for m in _ASCII.finditer(text)]
        if self._is_odd(text):
            return [span for _, span in self._tokenizer().pre_tokenizer.pre_tokenize_str(text)]
        return [m.span() for m in self.split.finditer(text)]

    def pre_tokens(self, text: str) -> list[str]:
        """Normalise and split a text that holds no special token."""
        return self.split_normal(self.normal(text))

    def _known(self, word: str) -> tuple[tuple[int, ...], str, str]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) + len(self.once) >= REMEMBERED:  # what hasn't been met since the last turn goes
                self.older, self.older_once, self.words, self.once = self.words, self.once, {}, {}
            found = self.older.get(word)
            if found is None:
                packed = self.once.pop(word, None) or self.older_once.pop(word, None)
                ids = tuple(map(self.numbers.__getitem__, self.encode_unsplit(word.encode("utf-8")) if packed is None else array("i", packed)))
                found = (ids, " ".join(map(str, ids)), self.decode(ids))
                if packed is None:  # more than half of the distinct pre-tokens are never met again
                    if len(word) <= LEAF:
                        self.once[word] = array("i", ids).tobytes()
                    return found
            self.words[word] = found
        return found

    def segments(self, text: str) -> list[str]:
        """The text cut before and after its special tokens."""
        if not any(map(text.__contains__, self.special)):
            return [text] if text else []
        return [x for x in self.cut.split(text) if x]

    def encode_parts(self, text: str) -> list[tuple[Sequence[int], str, str]]:
        """(ids, ids in decimals, decoded tokens) of each pre-token and special token."""
        out = []
        for piece in self.segments(text):
            if piece in self.special:
                out.append(([self.special[piece]], str(self.special[piece]), piece))
            else:
                out += [self._known(w) for w in self.pre_tokens(piece)]
        return out

    # -- halves -------------------------------------------------------------------

    def encode_piece(self, text: str, goes_on: bool) -> list[int]:
        """Ids of a piece of normalised text; the last pre-token may go on in the next piece."""
        words = self.split_normal(text)
        last = words.pop() if goes_on and words and text.endswith(words[-1]) else None
        ids = list(itertools.chain.from_iterable(self._known(w)[0] for w in words))
        return ids if last is None else ids + self.encode_unsplit(last.encode("utf-8"), False)

    def first_spans(self, text: str, k: int) -> list[tuple[int, int]]:
        """The first k pre-tokens of normalised text, or all; none holds a space, so that the text can be cut there."""
        to = text.find(" ", REACH * k)
        found = self.spans(text if to < 0 else text[:to])
        return found[:k] if to < 0 or len(found) >= k else self.first_spans(text, 2 * k)[:k]

    def last_spans(self, text: str, k: int) -> list[tuple[int, int]]:
        """The last k pre-tokens of normalised text, or all."""
        since = max(0, text.rfind(" ", 0, max(0, len(text) - REACH * k)))
        found = [(a + since, b + since) for a, b in self.spans(text[since:])]
        return found[-k:] if not since or len(found) >= k else self.last_spans(text, 2 * k)[-k:]

    def part(self, text: str, ids: list[int], goes_on: bool) -> Part:
        last = self.last_spans(text, 1) if goes_on else []
        return Part(text, array("i", ids), bool(last) and last[0][1] == len(text))

    def join_parts(self, left: Part, right: Part) -> Part:
        """Two pieces of text that follow each other, as one."""
        n = len(left.text)
        self.joins += 1
        a = b = 1
        while True:
            before, after = self.last_spans(left.text, a + 1), self.first_spans(right.text, b + 1)
            # of a half whose pre-tokens are all in the window nothing has to agree
            all_before, all_after = len(before) <= a, len(after) <= b
            before, after = (before if all_before else before[1:]), (after if all_after else after[:b])
            lo = 0 if all_before else before[0][0]
            window = left.text[lo:] + (right.text if all_after else right.text[: after[-1][1]])
            found = [(x + lo, y + lo) for x, y in self.spans(window)]
            left_agrees = all_before or (found and found[0] == before[0])
            right_agrees = all_after or (found and found[-1] == (after[-1][0] + n, after[-1][1] + n))
            if left_agrees and right_agrees:
                break
            a, b = (a if left_agrees else 2 * a), (b if right_agrees else 2 * b)
        # how many ids the pre-tokens of the window have in either half
        sizes = [self._size(left, x, len(before) == 1 and all_before) for x in before]
        opened = left.ids[len(left.ids) - sizes[-1] :].tolist() if left.open else []
        firsts = [self._size(right, x, len(after) == 1 and all_after) for x in after]
        ids = left.ids[: len(left.ids) - sum(sizes)]
        for s, e in found:
            if opened and s == before[-1][0] and e == n:
                ids.extend(self._closed(opened))
            elif opened and after and s == before[-1][0] and after[0][0] == 0 and e == n + after[0][1]:
                ids.extend(self._join(opened, right.ids[: firsts[0]].tolist()))
            elif right.open and e == n + len(right.text):
                ids.extend(self.encode_unsplit(window[s - lo :].encode("utf-8"), False))
            else:
                ids.extend(self._known(window[s - lo : e - lo])[0])
        return Part(left.text + right.text, ids + right.ids[sum(firsts) :], right.open)

    def _size(self, part: Part, span: tuple[int, int], only: bool) -> int:
        """How many ids a pre-token of a part has there."""
        if only:
            return len(part.ids)
        word = part.text[span[0] : span[1]]
        return len(self.encode_unsplit(word.encode("utf-8"), False) if part.open and span[1] == len(part.text) else self._known(word)[0])

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(p[0] for p in self.encode_parts(text)))

    def decode(self, ids: Sequence[int]) -> str:
        """Special tokens are kept."""
        return " ".join(self.names[i] for i in ids)


_loaded: dict[str, TreeBpe] = {}


def _coder(path: str) -> TreeBpe:
    if path not in _loaded:
        _loaded[path] = TreeBpe(path)
    return _loaded[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _digests(doc_ids: list, counts: list[int], shown: list[str], decoded: list[str]) -> pa.RecordBatch:
    """A batch of results by digests of the ids in decimals and of the decoded texts."""
    return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _results(doc_ids: list, ids: list[array], decoded: list[str]) -> pa.RecordBatch:
    """A batch of results by ids and decoded texts."""
    own, counts = pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in ids], pa.int64())
    flat = array("i")
    for x in ids:
        flat.extend(x)
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
    return pa.record_batch([own, counts, lists, pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])


def _whole(path: str, digests: bool):
    """Texts that are encoded without halving."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                doc_ids = part.column("doc_id").to_pylist()
                found = (coder.encode_parts(text or "") for text in part.column("text").to_pylist())
                if digests:
                    rows = [(sum([len(p[0]) for p in parts]), _sha(" ".join([p[1] for p in parts])), _sha(" ".join([p[2] for p in parts]))) for parts in found]
                    yield _digests(doc_ids, *map(list, zip(*rows, strict=True)))
                else:
                    rows = [(array("i", itertools.chain.from_iterable([p[0] for p in parts])), " ".join([p[2] for p in parts])) for parts in found]
                    yield _results(doc_ids, *map(list, zip(*rows, strict=True)))

    return run


PIECES = "doc long, doc_id long, place long, segment long, goes_on boolean, text string"


def _pieces(path: str):
    """Normalised pieces of long texts, and their special tokens, in order."""
    names, kinds = [c.split()[0] for c in PIECES.split(", ")], [pa.int64()] * 4 + [pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, doc = _coder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = []
                for segment, x in enumerate(coder.segments(text)):
                    cut = [x] if x in coder.special else halves(coder.normal(x))
                    rows += [(doc, doc_id, len(rows) + k, segment, k + 1 < len(cut), t) for k, t in enumerate(cut)]
                doc += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _packed(coder: TreeBpe) -> str:
    """The type in which ids travel between tasks."""
    return "<u2" if max(coder.names) < 1 << 16 else "<u4"


def _encoded(path: str):
    """Ids of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                part = batch.slice(lo, 16)
                ids = [[coder.special[t]] if t in coder.special else coder.encode_piece(t, goes_on) for t, goes_on in zip(part.column("text").to_pylist(), part.column("goes_on").to_pylist(), strict=True)]
                yield pa.record_batch([*part.columns, pa.array([np.array(x, _packed(coder)).tobytes() for x in ids], pa.binary())], names=[*part.schema.names, "ids"])

    return run


def _joined(path: str, digests: bool):
    """Pieces, sorted by document and place, joined two by two up the tree of halves."""

    def told(coder: TreeBpe, doc_id: int | None, ids: array) -> pa.RecordBatch:
        decoded = coder.decode(ids)
        return _digests([doc_id], [len(ids)], [_sha(" ".join(map(str, ids)))], [_sha(decoded)]) if digests else _results([doc_id], [ids], [decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, doc, ids = _coder(path), None, array("i")
        tree: list[tuple[int, Part]] = []  # joined parts, each with its height
        for batch in batches:
            for row in (r for lo in range(0, batch.num_rows, 16) for r in batch.slice(lo, 16).to_pylist()):
                if doc is not None and row["doc"] != doc[0]:
                    yield told(coder, doc[1], ids)
                    ids = array("i")
                doc = (row["doc"], row["doc_id"])
                own = np.frombuffer(row["ids"], _packed(coder)).tolist()
                if row["text"] in coder.special:
                    ids.extend(own)
                    continue
                tree.append((0, coder.part(row["text"], own, row["goes_on"])))
                while len(tree) > 1 and (tree[-1][0] == tree[-2][0] or not row["goes_on"]):
                    (height, left), (_, right) = tree[-2:]
                    tree[-2:] = [(height + 1, coder.join_parts(left, right))]
                if not row["goes_on"]:
                    ids.extend(tree.pop()[1].ids)
        if doc is not None:
            yield told(coder, doc[1], ids)

    return run


def _run(docs: DataFrame, path: str, digests: bool, schema: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > PIECE
    pieces = settle_table(rows.where(long).mapInArrow(_pieces(path), PIECES))
    encoded = pieces.repartition("doc", "place").mapInArrow(_encoded(path), f"{PIECES}, ids binary")
    joined = encoded.repartition("doc").sortWithinPartitions("doc", "place").mapInArrow(_joined(path, digests), schema)
    return rows.where(~long).mapInArrow(_whole(path, digests), schema).unionByName(joined)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and the decoded text of each document."""
    return _run(docs, path, False, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: as encode(), of which only digests leave the task."""
    return _run(docs, path, True, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
