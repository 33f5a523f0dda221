"""Byte-level BPE over Arrow batches with the tokenizers library.

A text is cut by the tokenizer's pattern; each piece's UTF-8 bytes are mapped to the byte-level characters, the
library's model merges them to ids.  Pieces and space-separated chunks that a worker has met are kept in bounded
caches, which changes the cost only.  Decoding maps ids to byte-level characters and these back to bytes; a character
whose bytes lie in several tokens comes back whole once its last byte is there.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Chunks and pieces kept per worker.
CACHE = 300_000
#: Bytes of ids that go out together.
_OUT = 4 << 20
_workers: dict[tuple[str, str, bool], "ByteBpe"] = {}


def byte_characters() -> dict[int, str]:
    """Byte -> printable character: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, tokenizer_file: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer_file)
        self.model, self.pieces = whole.model, regex.compile(pattern).findall
        table = byte_characters()
        self.to_characters = str.maketrans(table)
        back = {c: b for b, c in table.items()}
        special = set(whole.get_added_tokens_decoder())
        self.token_bytes = [b"" if i in special else bytes(back[c] for c in whole.id_to_token(i))
                            for i in range(whole.get_vocab_size())]
        self.simple = re.compile(" ?(?:[A-Za-z]|[À-ÖØ-öø-ÿ])+").fullmatch
        self.before_space = re.compile(r"[\s\x1c-\x1f\x85] ").search
        self.run = re.compile(r"[\s\x1c-\x1f\x85][\s\x1c-\x1f\x85]").search
        self.of_piece: dict[str, bytes] = {}
        self.of_chunk: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern, four little-endian bytes each."""
        found = self.of_piece.get(piece)
        if found is None:
            shown = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_characters)
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
            if len(self.of_piece) >= CACHE:
                self.of_piece.clear()
            if len(piece) < 64:
                self.of_piece[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self._piece(chunk) if self.simple(chunk) else b"".join(map(self._piece, self.pieces(chunk)))
        if len(self.of_chunk) >= CACHE:
            self.of_chunk.clear()
        if len(chunk) < 64:
            self.of_chunk[chunk] = found
        return found

    def _chunks(self, text: str) -> list[str]:
        """Parts of a text that can be encoded alone.

        A space after something that is not white space always begins a piece, so a text without other white space
        before a space may be cut at its spaces first; without any runs of white space each line end is a piece, too.
        """
        if "\x00" in text:
            return [text]
        if not self.run(text):
            return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
        if not self.before_space(text):
            return text.replace(" ", "\x00 ").split("\x00")
        return [text]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        known, out = self.of_chunk, []
        for chunk in self._chunks(text):
            ids = known.get(chunk)
            out.append(self._chunk(chunk) if ids is None else ids)
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        table = self.token_bytes
        return b"".join([table[i] for i in memoryview(ids).cast("I")])

    def decode_pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """Text that each id completes; a split character appears with the id that ends it."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        ids = list(ids)
        for k, i in enumerate(ids):
            yield decoder.decode(self.token_bytes[i], final=k == len(ids) - 1)

    def offsets(self, ids: Iterable[int]) -> list[tuple[int, int]]:
        """Code points (start, end) each id touches; ids that share a split character share its place."""
        spans, bytes_at, points = [], 0, []
        for i in ids:
            b = self.token_bytes[i]
            points += [(x & 0xC0) != 0x80 for x in b]
            spans.append((bytes_at, bytes_at + len(b)))
            bytes_at += len(b)
        seen, place = 0, []
        for first in points:
            seen += first
            place.append(seen - 1)
        return [(place[a], place[b - 1] + 1) if b > a else (seen, seen) for a, b in spans]


class RankedBpe(ByteBpe):
    """The same ids by the tiktoken library, in one call for all new chunks of plain Latin characters of a text.

    Only for tokenizers whose ids are the ranks of their merges, such as the public one.
    """

    def __init__(self, tokenizer_file: str, pattern: str):
        import tiktoken

        super().__init__(tokenizer_file, pattern)
        ranks = {b: i for i, b in enumerate(self.token_bytes) if b}
        self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.newline = ranks[b"\n"]
        # Both libraries cut these characters alike.  A line end between two such chunks is always a piece of its own.
        self.plain = re.compile(" ?[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.all_plain = re.compile(" ?[!-~À-ÖØ-öø-ÿ]+(?:\n ?[!-~À-ÖØ-öø-ÿ]+)*").fullmatch

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        text = "\n".join(chunks)
        if not self.all_plain(text):
            plain = [c for c in chunks if self.plain(c)]
            others = {c: super(RankedBpe, self)._chunk(c) for c in chunks if not self.plain(c)}
            return others | (self._learn(plain) if plain else {})
        ids = self.ranked(text)
        at, data = [-1, *np.flatnonzero(ids == self.newline).tolist(), ids.size], ids.astype("<u4").tobytes()
        return {c: data[4 * a + 4:4 * b] for c, a, b in zip(chunks, at, at[1:])}

    def _chunks(self, text: str) -> list[str]:
        if not text.replace("\n", "").isprintable() or "\n " in text or "  " in text:
            return super()._chunks(text)
        # spaces and line ends are the only white space, and none stands before a space
        if "\n\n" not in text and " \n" not in text:
            text = text.replace("\n", "\x00\n\x00")
        return text.replace(" ", "\x00 ").split("\x00")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        chunks, known = self._chunks(text), self.of_chunk
        out = list(map(known.get, chunks))
        if None in out:
            new = self._learn(list(dict.fromkeys([c for c, ids in zip(chunks, out) if ids is None])))
            out = [new[c] if ids is None else ids for c, ids in zip(chunks, out)]
            if len(known) + len(new) > CACHE:
                known.clear()
            known.update(new if len(max(new, key=len)) < 64 else {c: ids for c, ids in new.items() if len(c) < 64})
        return b"".join(out)


def worker_bpe(tokenizer_file: str, pattern: str, ranked: bool = False) -> ByteBpe:
    """The encoder of this Python worker, loaded once."""
    key = (tokenizer_file, pattern, ranked)
    if key not in _workers:
        _workers[key] = (RankedBpe if ranked else ByteBpe)(tokenizer_file, pattern)
    return _workers[key]


def public_files() -> tuple[str, str]:
    """Default tokenizer file and pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, tokenizer_file: str | None = None, pattern: str | None = None,
                     with_ids: bool = True, with_offsets: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, starts, ends]) for every row of (doc_id, text).

    ``ids`` holds 32-bit ids, ``starts`` and ``ends`` code points of each id.  The digests are of the ids as
    little-endian unsigned 32-bit numbers and of the bytes decoded from them.  Null and empty texts have no ids; rows
    with null or repeated doc_ids are kept as they are; other columns are ignored; no row gives no row.  A task holds
    one Arrow batch and two bounded caches.
    """
    file, cut_by = tokenizer_file or public_files()[0], pattern or public_files()[1]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", starts array<int>, ends array<int>" * with_offsets

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *(p.size for p in parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))

    def rows_of(bpe: ByteBpe, doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
        counts, kept, digests = [], [], []
        for ids in texts:
            counts.append(len(ids) // 4)
            digests.append((hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode_bytes(ids)).hexdigest()))
            if with_ids or with_offsets:
                kept.append(np.frombuffer(ids, np.int32))
        columns = [pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), *(pa.array([d[k] for d in digests], pa.string()) for k in (0, 1))]
        if with_ids:
            columns.append(lists(kept))
        if with_offsets:
            spans = [np.array(bpe.offsets(ids.tolist()), np.int32).reshape(-1, 2) for ids in kept]
            columns += [lists([p[:, k] for p in spans]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(file, cut_by)
        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_ids.append(doc_id.as_py())
                texts.append(bpe.encode(text.as_py() or ""))
                size += len(texts[-1])
                if size > _OUT:
                    yield rows_of(bpe, doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
            if doc_ids:
                yield rows_of(bpe, doc_ids, texts)

    return docs.select("doc_id", "text").mapInArrow(task, schema)
