"""Distinct stretches of texts, with numpy and Arrow: exact codes instead of hashes, a block of whole texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import sliced

#: UTF-8 bytes of texts that are looked at together.
GROUP_BYTES = 4 << 20


def groups(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Whole rows, a bounded number of bytes of ``text_col`` at a time; a longer text is alone or nearly so."""
    held, size = [], 0
    for batch in sliced(batches, text_col):
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text_col)).nbytes
        if size >= GROUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array, one text after the other, and where each text begins and the last one ends; nulls are empty."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(inside: np.ndarray, cuts: np.ndarray | None, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal runs of ``inside`` begin and end; runs also end where ``cuts`` marks a position that begins one, and at the ends of texts."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] if cuts is None else ~inside[:-1] | cuts
    inner = offsets[:-1][(offsets[:-1] < len(inside))]
    begins[inner] = inside[inner]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def coded(joined: bytes, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A code for each of the stretches that ``joined`` holds one after the other, and the distinct ones (binary): exact, not by hash alone."""
    kind, width = (pa.large_binary(), np.int64) if len(joined) >= 1 << 31 else (pa.binary(), np.int32)
    lengths = np.zeros(len(sizes) + 1, width)
    np.cumsum(sizes, out=lengths[1:])
    codes = pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(lengths), pa.py_buffer(joined)]).dictionary_encode()
    return codes.indices.to_numpy(), codes.dictionary


def as_bytes(distinct: pa.Array) -> list[bytes]:
    """The stretches of a binary array as Python objects."""
    data, offsets = text_bytes(distinct)
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


_SPACE = b"\t\n\v\f\r "
#: White space 0, letters 4, stops 8, other bytes 1: neighbours whose classes together make 12 are a letter and a stop.
_CLASSES = bytes(0 if c in _SPACE else 4 if chr(c).isalpha() and c < 128 else 8 if c in b".,;:!?" else 1 for c in range(256))


def unit_codes(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Units that a tokenizer of words encodes alike wherever they stand: ``(codes, units, first)``, the units of text ``i`` being ``codes[first[i]:first[i + 1]]``.

    A text is cut at ASCII white space, which goes, and between an ASCII letter and one of ``.,;:!?``: no word pattern reaches
    over these places, and no normal form joins characters over them.
    """
    data, offsets = text_bytes(texts)
    raw = data.tobytes()
    kinds = np.frombuffer(raw.translate(_CLASSES), np.uint8)
    begin, end = spans(kinds != 0, (kinds[:-1] | kinds[1:]) == 12, offsets)
    codes, units = coded(raw.translate(None, _SPACE), end - begin)
    return codes, as_bytes(units), np.searchsorted(begin, offsets)
