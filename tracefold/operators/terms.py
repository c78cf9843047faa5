"""Terms of batches of documents as integers, for the Arrow stages of ``features``.

A batch numbers its distinct words and n-grams once; counts are sorts of (document, term) numbers.
Strings are built for the distinct terms of a batch only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens, and (document, term) pairs, that are numbered at a time; a document stays whole.
TOKENS, PAIRS = 1 << 19, 1 << 22


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list]]:
    """(ids, document of each row, token lists per column) of rows that come ordered by id.

    Rows of one id are one document; the last one waits for the next batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        yield from _cut(table, last=False, held=held)
    if held:
        yield from _cut(pa.Table.from_batches(held).combine_chunks(), last=True, held=held)


def _cut(table: pa.Table, last: bool, held: list) -> Iterator[tuple]:
    ids = table.column(0).combine_chunks()
    code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    end = len(code) if last else int(first[-1])
    held.clear()
    if not last:
        held.extend(table.slice(end).to_batches())
        first = first[:-1]
    if not end:
        return
    sizes = sum(
        pc.fill_null(pc.list_value_length(table.column(c)), 0).to_numpy().astype(np.int64) for c in range(1, table.num_columns)
    )
    # Tokens before each document, in parts of TOKENS.
    before = np.cumsum(sizes)[first] - sizes[first]
    part = before // TOKENS
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() + [len(first)]
    edges = np.r_[first, end]
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, hi = int(edges[a]), int(edges[b])
        document = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
        rows = table.slice(lo, hi - lo)
        columns = [rows.column(c).combine_chunks() for c in range(1, table.num_columns)]
        yield ids.take(pa.array(edges[a:b])), document, columns


def _tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number) of every token, and the distinct tokens."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(lists.flatten())
    return np.repeat(np.arange(len(lists)), sizes), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_terms(lists: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, term) of every n-gram of tokens, and the distinct terms."""
    row, code, names = _tokens(lists)
    size, rows, terms, strings, offset = max(len(names), 1), [], [], [], 0
    key, text = code, names
    for n in range(1, high + 1):
        if n > 1:
            # Runs of n-1 tokens that have another token of their row behind them.
            at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
            runs, place, key_at = np.unique(key[at] * size + code[at + n - 1], return_index=True, return_inverse=True)
            head, tail = key[at][place], code[at + n - 1][place]
            text = pc.binary_join_element_wise(text.take(pa.array(head)), names.take(pa.array(tail)), " ")
            key = np.zeros(len(row), np.int64)
            key[at] = key_at
        else:
            at = np.arange(len(row))
        if n >= low:
            rows.append(row[at])
            terms.append(key[at] + offset)
            strings.append(text)
            offset += len(text)
    return np.concatenate(rows), np.concatenate(terms), pa.concat_arrays(strings)


def _strings(points: np.ndarray) -> pa.Array:
    """A string per row of code points."""
    width = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).sum(1)
    offsets = np.r_[0, np.cumsum(width)].astype(np.int32)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(data))


def char_terms(words: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word, term) of every n-gram of every padded word, by word, and the distinct terms.

    A padded word shorter than ``low`` is one term.
    """
    padded = pc.binary_join_element_wise("", words, "", " ")
    length = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.array([padded.to_pylist()], pa.list_(pa.string())), "")[0].as_py() or ""
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    alphabet, code = np.unique(points, return_inverse=True)
    code, size = code.astype(np.int64), max(len(alphabet), 1)
    end = np.cumsum(length)
    word = np.repeat(np.arange(len(words)), length)
    left = end[word] - np.arange(len(points))  # characters from here to the end of the word
    start = left == length[word]
    owner, terms, strings, offset = [], [], [], 0
    key, bound = code, size
    for n in range(1, high + 1):
        if n > 1:
            if bound > (1 << 62) // size:
                _, key = np.unique(key, return_inverse=True)
                bound = int(key.max()) + 1 if len(key) else 1
            key = key[: len(points) - n + 1] * size + code[n - 1 :]
            bound *= size
        at = np.flatnonzero(left[: len(key)] >= n) if n >= low else np.flatnonzero(start[: len(key)] & (length[word[: len(key)]] == n))
        _, place, number = np.unique(key[at], return_index=True, return_inverse=True)
        owner.append(word[at])
        terms.append(number + offset)
        strings.append(_strings(points[at[place][:, None] + np.arange(n)]))
        offset += len(place)
    owner, terms = np.concatenate(owner), np.concatenate(terms)
    order = np.argsort(owner, kind="stable")
    return owner[order], terms[order], pa.concat_arrays(strings)


def _expanded(document: np.ndarray, word: np.ndarray, owner: np.ndarray, many: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Blocks of whole documents: (their cells, cell of each pair, place of the pair's term).

    ``owner``: word of each term, ascending; cells (document, word) are ordered by document.
    """
    count = np.bincount(owner, minlength=many)
    start = np.cumsum(count) - count
    size = count[word]
    through = np.cumsum(size)
    first = np.flatnonzero(np.r_[True, document[1:] != document[:-1]]) if len(document) else np.zeros(0, np.int64)
    part = (through[first] - size[first]) // PAIRS
    cuts = first[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])].tolist() + [len(document)] if len(first) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        cell = np.repeat(np.arange(a, b), size[a:b])
        base = start[word[a:b]] - (through[a:b] - size[a:b] - (through[a] - size[a]))
        yield slice(a, b), cell, np.arange(len(cell)) + base[cell - a]


def _cells(row: np.ndarray, token: np.ndarray, document: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, count), by document and token."""
    key, n = np.unique(document[row] * many + token, return_counts=True)
    return key // many, key % many, n


def statistics(spec, document: np.ndarray, lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, documents with the term, occurrences)."""
    if spec.analyzer == "word":
        row, term, names = word_terms(lists, spec.ngram_min, spec.ngram_max)
        many = max(len(names), 1)
        d, t, n = _cells(row, term, document, many)
        return names, np.bincount(t, minlength=len(names)), np.bincount(t, n, len(names)).astype(np.int64)
    row, token, words = _tokens(lists)
    owner, term, names = char_terms(words, spec.ngram_min, spec.ngram_max)
    many = max(len(words), 1)
    uses = np.bincount(token, minlength=many)
    total = np.bincount(term, uses[owner], len(names)).astype(np.int64)
    df = np.zeros(len(names), np.int64)
    d, w, _ = _cells(row, token, document, many)
    for _, cell, place in _expanded(d, w, owner, many):
        pairs = d[cell] * len(names) + term[place]
        pairs.sort()
        kept = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        df += np.bincount(kept % max(len(names), 1), minlength=len(names))
    return names, df, total


def known_counts(spec, document: np.ndarray, lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number in ``terms``, count) of the known terms, by document and number."""
    size = max(len(terms), 1)
    if spec.analyzer == "word":
        row, term, names = word_terms(lists, spec.ngram_min, spec.ngram_max)
        number = _numbers(names, terms)[term]
        known = number >= 0
        return _cells(row[known], number[known], document, size)
    row, token, words = _tokens(lists)
    owner, term, names = char_terms(words, spec.ngram_min, spec.ngram_max)
    number = _numbers(names, terms)[term]
    owner, number = owner[number >= 0], number[number >= 0]
    many = max(len(words), 1)
    d, w, n = _cells(row, token, document, many)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, cell, place in _expanded(d, w, owner, many):
        if not len(cell):
            continue
        pairs = d[cell] * size + number[place]
        order = np.argsort(pairs)
        pairs = pairs[order]
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        keys.append(pairs[first])
        counts.append(np.add.reduceat(n[cell[order]], first))
    key = np.concatenate(keys)
    return key // size, key % size, np.concatenate(counts)


def _numbers(names: pa.Array, terms: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
