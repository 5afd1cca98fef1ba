"""Operator 11: encode and decode texts with a merge-type SentencePiece vocabulary.

A text gets its leading space mark and every space becomes a mark. No piece of such a
vocabulary has a mark after another character (checked when it is loaded), so nothing
merges across the start of a run of marks and the text falls into segments there. Within a
segment an agenda holds the adjacent symbol pairs that form a piece: the highest score is
merged first, the leftmost of equals, and an entry whose symbols have changed meanwhile is
passed over. Symbols that are no piece become their bytes. Segments recur, so a worker
remembers a bounded number of them.

Each Arrow batch is checked against the sentencepiece library: its new segments are encoded
by both, and every text's ids are decoded by both. `matches_library` says whether they agree;
the ids and texts are the agenda's in any case.

Defined cases: null text is the empty text, whose only id is the end mark; bytes that are no
UTF-8 become U+FFFD one by one, as in the library; a mark that stands in the text decodes
to a space, as in the library; repeated rows are encoded once each; an empty table gives no rows;
other columns are left out. The length of a text bounds what is held for it.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from stopwise.llm.cluster import prepare

MODEL = "piece_bpe_32k.model"
MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
PLACE = (1 << 32) - 1
NEVER = 1 << 63
SHORT = 48  # symbols
REMEMBERED = 1 << 18  # segments in each of two generations
LONGEST = 64  # characters of a segment that is worth remembering
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, matches_library boolean"

_vocabularies: dict[str, Vocabulary] = {}


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each_byte", _each_byte)


class Vocabulary:
    """Pieces, scores and bytes of a model; `encode` and `decode` work from them alone."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(library.get_piece_size())
        pieces = [library.id_to_piece(i) for i in kinds]
        plain = [i for i in kinds if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        self.ids = {pieces[i]: i for i in plain}
        order = {score: rank for rank, score in enumerate(sorted({library.get_score(i) for i in plain}, reverse=True))}
        self.ranks = {pieces[i]: order[library.get_score(i)] << PLACE.bit_length() for i in plain}  # an agenda entry: rank, then place
        self.bytes = [i for i in kinds if library.is_byte(i)]
        self.control = {i for i in kinds if library.is_control(i)}
        self.end = library.eos_id()
        self.decimal = [str(i) for i in kinds]
        self.surface = [b"" if library.is_control(i) else library.unk_id() == i and b" \xe2\x81\x87 " or pieces[i].replace(MARK, " ").encode() for i in kinds]
        for value, i in enumerate(self.bytes):
            self.surface[i] = bytes([value])
        self.leading = {i for i in plain if pieces[i].startswith(MARK)}
        probe = " Åﬁ  x "
        if len(self.bytes) != 256 or any(library.is_unused(i) or re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in plain) or self.encode_one(probe) != library.encode(probe, add_eos=True):
            raise ValueError("needs a merge-type vocabulary with byte pieces, a leading mark and no normalisation")
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.fresh: list[str] = []
        self.wrong: set[str] = set()

    def merged(self, segment: str) -> list[int]:
        """Ids of one segment."""
        ranks, known = self.ranks, self.ids
        rank = ranks.get
        parts: list[str | None] = list(segment)
        if len(parts) > SHORT:
            self.merge_long(parts)
        else:  # few pairs: the agenda is a list in their order, whose least entry is found by looking at all
            agenda = [rank(pair, NEVER) for pair in map(str.__add__, segment, segment[1:])]
            while agenda and (best := min(agenda)) != NEVER:
                i = agenda.index(best)
                parts[i] = pair = parts[i] + parts.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = rank(pair + parts[i + 1], NEVER)
                if i:
                    agenda[i - 1] = rank(parts[i - 1] + pair, NEVER)
        ids = []
        for part in parts:
            if part in known:
                ids.append(known[part])
            elif part is not None:
                ids += [self.bytes[b] for b in part.encode()]
        return ids

    def merge_long(self, parts: list[str | None]) -> None:
        """Merge in place; a symbol merged into its left neighbour becomes None. Entries of the heap: rank, then place."""
        ranks = self.ranks
        last = len(parts)
        agenda = [ranks[pair] | i for i, pair in enumerate(map(str.__add__, parts, parts[1:])) if pair in ranks]
        heapify(agenda)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        while agenda:
            entry = heappop(agenda)
            left = entry & PLACE
            if parts[left] is None or (right := after[left]) == last:
                continue
            pair = parts[left] + parts[right]
            if ranks.get(pair) != entry ^ left:
                continue
            parts[left], parts[right] = pair, None
            beyond = after[left] = after[right]
            if beyond < last:
                before[beyond] = left
                if (joined := pair + parts[beyond]) in ranks:
                    heappush(agenda, ranks[joined] | left)
            first = before[left]
            if first >= 0 and (joined := parts[first] + pair) in ranks:
                heappush(agenda, ranks[joined] | first)

    def encode_one(self, text: str) -> list[int]:
        """Ids without memory or check."""
        return [i for s in SEGMENT.findall(MARK + text.replace(" ", MARK)) for i in self.merged(s)] + [self.end] if text else [self.end]

    def segments(self, texts: list[str]) -> list[list[str]]:
        """Segments of each text; those not remembered are encoded here, and by the library."""
        cut = [SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        self.fresh = []
        new, old = self.new, self.old
        for segment in {s for found in cut for s in found if s not in new}:
            ids = old.get(segment)
            if ids is None:
                ids = tuple(self.merged(segment))  # the garbage collector need not visit it
                self.fresh.append(segment)
            new[segment] = ids
        asked = [s for s in self.fresh if s != MARK]  # the library itself puts the first mark; alone it puts none
        self.wrong = {s for s, ids in zip(asked, self.library.encode([s[1:] for s in asked], num_threads=1)) if tuple(ids) != new[s]}
        return cut

    def forget(self) -> None:
        """Long segments go after their batch, and so do those that were wrong, which are then checked again."""
        for segment in self.fresh:
            if len(segment) > LONGEST or segment in self.wrong:
                del self.new[segment]

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """Ids of each text, the end mark included, and whether the library has the same for all its segments."""
        out = []
        for found in self.segments(texts):
            ids: list[int] = []
            for segment in found:
                ids += self.new[segment]
            ids.append(self.end)
            out.append((ids, not self.wrong or self.wrong.isdisjoint(found)))
        self.forget()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes make characters only where they stand together."""
        text, start = "", 0
        ends = [] if self.control.isdisjoint(ids[:-1]) else [i for i, x in enumerate(ids) if x in self.control]
        for end in [*ends, len(ids)]:
            text += b"".join(map(self.surface.__getitem__, ids[start:end])).decode("utf-8", "each_byte")
            start = end
        first = next((i for i in ids if self.surface[i]), None)
        return text[1:] if first in self.leading else text


def vocabulary(model: str = MODEL) -> Vocabulary:
    if model not in _vocabularies:
        _vocabularies[model] = Vocabulary(public_tokenizers.path(model))
    return _vocabularies[model]


def slices(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` characters each."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids array<int> (end mark last), decoded string, matches_library."""
    return _mapped(docs, model, "doc_id long, ids array<int>, decoded string, matches_library boolean", lambda vocab, ids, text: (ids, text))


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """A row for each document, see SCHEMA: number of ids, digests of the ids in decimal and of the decoded text."""

    def digest(vocab: Vocabulary, ids: list[int], text: str) -> tuple:
        decimal = " ".join(map(vocab.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _mapped(docs, model, SCHEMA, digest)


def _mapped(docs: DataFrame, model: str, schema: str, result) -> DataFrame:
    prepare(docs.sparkSession)
    names = [field.split()[0] for field in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[field.split()[1]] for field in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what is made here has no cycles, and looking for some takes a fifth of the time
        try:
            yield from coded(batches)
        finally:
            gc.enable()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            texts = [(t or b"").decode("utf-8", "each_byte") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for start, end in slices(texts):
                rows = []
                for key, (ids, same) in zip(keys[start:end], vocab.encode(texts[start:end])):
                    text = vocab.decode(ids)
                    rows.append((key, *result(vocab, ids, text), same and vocab.library.decode(ids) == text))
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(encode, schema)
