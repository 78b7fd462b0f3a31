"""LM scoring with a probabilistic suffix tree over words.

The tree's states are contexts of up to ``depth`` words. It grows from the root: a context that occurs ``LEAST`` times, and
whose suffix without the first word is a state, is a state itself if its next-symbol distribution diverges from that of
the suffix: sum of count * ln(P(symbol | context) / P(symbol | suffix)) over the symbols that follow it ``LEAST`` times, and
of what the other followers lose, must reach ``GAIN``. So each branch ends where the corpus ends it. Followers of a state
hold their own probability, less ``DISCOUNT`` of a count; what is left of the mass goes to the suffix's distribution, down
to the root, where every word has (c + 0.5) / (N + 0.5 (V + 1)). So each state's distribution sums to one. A text is scored
at each token from the longest suffix that is a state.

Sizes: the tree grows with the input, and none of it is broadcast or gathered. Texts are cut into words by Arrow, some
``CUT_BYTES`` at once, whose different words are hashed once, and put into chunks of symbols, which are written once. For each length of context a chunk asks the buckets, ranges of the contexts' hashes, about its distinct
contexts and what follows them, with its own counts; a bucket sums the counts of all chunks, tests its contexts, and answers
each chunk. Chunks and answers are bucketed alike, so that they meet without a shuffle. Groups and buckets exchange one row
a pair: as the corpus grows, more chunks, ``TOGETHER`` at most, ask as one group, so that rows neither become many nor
small. A group's chunks are gone through one by one. A context asks for as many parts as it holds ``SPLIT`` occurrences,
followers dealt by hash, and no bucket gets a frequent word as a whole: the test is a sum over parts.

Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z lowered, then one end. Edge cases (tested): a null text is an empty one, its
only token is the end; a null id is scored and not learnt from; rows that repeat are each scored; without training
documents every token has probability 1; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

#: Contexts and followers of states occur at least this often.
LEAST = 2
GAIN = 10.0
DISCOUNT = 0.75
#: Words of the longest context that is tried.
DEPTH = 3
#: Tokens of a chunk.
CHUNK_WORDS = 500_000
#: Bytes of texts that are cut into words at once, and hash each word once, unless one text has more.
CUT_BYTES = 4_000_000
#: Bytes of text for each bucket of contexts.
BUCKET_BYTES = 8_000_000
#: Chunks of a group: one for so many bytes of all texts, and so many at most.
GROUP_BYTES, TOGETHER = 400_000_000, 4
#: Occurrences of a context for each part that it is dealt to.
SPLIT = 1_000_000
#: The end of a text as a symbol; no word has it, as hashes of words are shifted by one bit.
END = np.uint64(1)
#: Probabilities travel as logarithms in these steps.
_STEP = 1024
_FOLLOWER = np.uint64(40)

_ROWS = "group_id long, kind int, bucket long, data binary"
_ROWS_SCHEMA = pa.schema([("group_id", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("data", pa.binary())])
#: Kinds of rows: a chunk's symbols, a group's words, and from 1 up contexts of so many words; sums over a bucket's words;
#: what a chunk keeps for the scores. A chunk's own rows have its number in the group as their bucket.
TEXT, WORDS, TOTAL, DISTINCT, KEPT = -1, 0, -2, -3, -4
#: Files of a table of groups, at most, and bytes of text for each.
FILES, FILE_BYTES = 20_000, 32_000_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and the words of all, one after another, with A-Z lowered."""
    kind = {pa.binary(): pa.string(), pa.large_binary(): pa.large_string()}.get(texts.type, texts.type)
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(kind)))  # goes by bytes, valid UTF-8 or not
    words, ends = split.values, split.offsets.to_numpy()
    held = pc.binary_length(words).to_numpy() > 0  # white space at either end leaves an empty word
    if not held.all():
        words, ends = words.filter(pa.array(held)), np.r_[0, np.cumsum(held)][ends]
    return np.diff(ends), words


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text, 64-bit symbols of the distinct words of all, and for each word the place of its symbol."""
    sizes, words = words_of(texts)
    words = words.dictionary_encode()
    kind = pa.large_binary() if pa.types.is_large_string(words.type.value_type) else pa.binary()
    return sizes, common.hashed(words.dictionary.cast(kind).to_numpy(zero_copy_only=False)) << np.uint64(1), words.indices.to_numpy()


def _planes(x: np.ndarray) -> int:
    """Bytes of an entry that may differ from zero."""
    if x.dtype.kind != "u" or not len(x):
        return x.itemsize
    return max(1, (int(x.max()).bit_length() + 7) // 8)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of bytes, compressed together; the highest planes of unsigned numbers are left out where they are zeros."""
    kinds, planes = [], []
    for x in arrays:
        used, bytes_of = _planes(x), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
        kinds.append((x.dtype.str, len(x), used))
        planes += [np.ascontiguousarray(bytes_of[:, k]) for k in range(used)]
    return pickle.dumps((kinds, zstandard.ZstdCompressor(level=1).compress(b"".join(planes))))


def _unpacked(data: bytes) -> list[np.ndarray]:
    kinds, data = pickle.loads(data)
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind, n, used in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * used, at).reshape(used, n)
        if size == 1:
            out.append(planes[0].view(kind))
        elif used == 1:
            out.append(planes[0].astype(kind))
        else:
            x = np.zeros((n, size), np.uint8)
            for k in range(used):
                x[:, k] = planes[k]
            out.append(x.view(kind).reshape(-1))
        at += n * used
    return out


def _steps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries, none of them negative, in order, and the place of each."""
    bits = len(x).bit_length()
    if not len(x) or int(x.max()).bit_length() + bits > 64:
        order = np.argsort(x)
        return x[order], order
    # value and place in one word: sorting words is several times as fast
    both = x.astype(np.uint64)
    both <<= np.uint64(bits)
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << bits) - 1)).view(np.int64)
    both >>= np.uint64(bits)
    return both.astype(x.dtype, copy=False), order


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in increasing order, a place of each, and the number of each entry's value among them."""
    if not len(x):
        return x, np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, order = _sorted(x)
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    rank = np.cumsum(new)
    rank -= 1
    number = np.empty(len(x), np.int64)
    number[order] = rank
    return values[new], order[new], number


def _cuts(sorted_keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the keys of each bucket, a range of keys, that has any."""
    least = (((np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets)) << np.uint64(32)
    ends = [0, *np.searchsorted(sorted_keys, least).tolist(), len(sorted_keys)]
    return [(b, x, y) for b, (x, y) in enumerate(zip(ends, ends[1:])) if x < y]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS_SCHEMA)], schema=_ROWS_SCHEMA)


def _chunked(most: int, together: int):
    """(doc_id, text, train) as rows of chunks of so many tokens, so many chunks a group."""

    def out(no, ids, train, sizes, parts):
        """``parts``: hashes, and for each word the place of its own; the end comes after each text's words."""
        sizes, hashes, words, had = np.concatenate(sizes), [], [], 0
        for some, places in parts:
            used = np.zeros(len(some), bool)
            used[places] = True
            hashes.append(some[used])
            words.append((np.cumsum(used) + (had - 1))[places])
            had += len(hashes[-1])
        every, _, of = _numbered(np.r_[*hashes, END])
        ends = np.cumsum(sizes + 1) - 1
        number = np.empty(int(sizes.sum()) + len(sizes), np.uint32)
        inside = np.ones(len(number), bool)
        inside[ends] = False
        number[ends], number[inside] = of[-1], of[np.concatenate(words)]
        group, place = divmod(no, together)
        return _batch([((TaskContext.get().partitionId() << 32) + group, TEXT, place, pickle.dumps((ids, _packed(np.array(train, bool), sizes + 1, _steps(every), number))))])

    def run(it):
        no, ids, train, sizes, parts, size = 0, [], [], [], [], 0
        for some, texts, flags in common.column_batches(it, "doc_id", "text", "train"):
            some, flags, texts = some.to_pylist(), flags.to_pylist(), _whole(texts)
            for begin, end in _runs(texts):
                n, hashes, places = cut(texts.slice(begin, end - begin))
                ends, done = np.cumsum(n), 0
                while done < len(n):
                    # up to the text with which the chunk is full
                    before = int(ends[done - 1]) if done else 0
                    upto = min(len(n), done + 1 + int(np.searchsorted(ends[done:] - before + np.arange(1, len(n) - done + 1), most - size)))
                    ids += some[begin + done : begin + upto]
                    train += flags[begin + done : begin + upto]
                    sizes.append(n[done:upto])
                    parts.append((hashes, places[before : int(ends[upto - 1])]))
                    size += int(sizes[-1].sum()) + upto - done
                    done = upto
                    if size >= most:
                        yield out(no, ids, train, sizes, parts)
                        no, ids, train, sizes, parts, size = no + 1, [], [], [], [], 0
        if ids:
            yield out(no, ids, train, sizes, parts)

    return run


def _whole(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts


def _runs(texts: pa.Array) -> list[tuple[int, int]]:
    """(begin, end) of consecutive texts that have CUT_BYTES together, or little more than that."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.flatnonzero(np.diff(size // CUT_BYTES, append=-1)) + 1
    return list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))


class Asked:
    """What the chunks of a group ask the buckets, one chunk after another."""

    def __init__(self):
        self.by_bucket: dict[int, list[list[np.ndarray]]] = {}

    def add(self, bucket: int, *arrays: np.ndarray) -> None:
        self.by_bucket.setdefault(bucket, []).append(arrays)

    def rows(self, kind: int, packed) -> list[tuple[int, int, bytes]]:
        return [(kind, b, packed(*(x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*self.by_bucket[b], strict=True)))) for b in sorted(self.by_bucket)]


class Answers:
    """The answers to a group, given out to its chunks in the order in which they asked."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        """``rows``: (kind, bucket, data), of any kinds."""
        self.arrays = {(kind, bucket): _unpacked(data) for kind, bucket, data in rows if kind >= WORDS}
        self.given: dict[tuple[int, int], tuple[int, int]] = {}

    def take(self, kind: int, cuts: list[tuple[int, int, int]]) -> list[np.ndarray]:
        """The next so many entries of the arrays by part, and of the last array, from each (bucket, parts, grams)."""
        out = []
        for bucket, parts, grams in cuts:
            *by_part, by_gram = self.arrays[kind, bucket]
            x, y = self.given.get((kind, bucket), (0, 0))
            out.append([*(a[x : x + parts] for a in by_part), by_gram[y : y + grams]])
            self.given[kind, bucket] = x + parts, y + grams
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def _texts(rows: list[tuple[int, int, bytes]], kind: int = TEXT) -> list[bytes]:
    """Data of the chunks of a group, in their order."""
    return [d for _, d in sorted((b, d) for k, b, d in rows if k == kind)]


def _asked_words(buckets: int):
    """A group's words, with their counts in its training texts, to the buckets."""

    def run(key, table):
        asked = Asked()
        for data in _texts(_rows_of(table)):
            train, sizes, every, number = _unpacked(pickle.loads(data)[1])
            n = np.bincount(number[np.repeat(train, sizes)], minlength=len(every)).astype(np.uint64)
            keys = np.cumsum(every)
            for b, x, y in _cuts(keys, buckets):
                asked.add(b, keys[x:y], n[x:y])
        return pa.Table.from_batches([_batch([(key[0].as_py(), *a) for a in asked.rows(WORDS, lambda keys, n: _packed(_steps(keys), n))])], _ROWS_SCHEMA)

    return run


def _counted_words(table):
    """A bucket's answers: the counts of all groups; and in rows without a group its tokens and distinct words, as numbers."""
    asked = [(c, b, *_unpacked(d)) for c, b, d in zip(table["group_id"].to_pylist(), table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True)]
    keys, _, of = _numbered(np.concatenate([np.cumsum(k) for _, _, k, _ in asked]))
    n = np.bincount(of, np.concatenate([x for _, _, _, x in asked]), len(keys)).astype(np.uint64)
    out, at = [(-1, TOTAL, int(n.sum()), None), (-1, DISTINCT, int((n > 0).sum()), None)], 0
    for group, bucket, k, _ in asked:
        out.append((group, WORDS, bucket, _packed(n[of[at : at + len(k)]])))
        at += len(k)
    return pa.Table.from_batches([_batch(out)], _ROWS_SCHEMA)


@dataclass
class Level:
    """A chunk's contexts of one length: the asked ones, and where they stand in it."""

    #: Tokens that have such a context, and the number of the context before each.
    at: np.ndarray
    context: np.ndarray
    #: Tokens of those that may follow it often enough, their contexts, and the number of each one's gram.
    follows: np.ndarray
    after: np.ndarray
    gram: np.ndarray
    #: Keys of the parts, sorted; the part of each (context, part number), and of each gram.
    keys: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    part_of: np.ndarray
    gram_part: np.ndarray
    #: Grams in order of their parts; the place of one of each one's tokens, and its context.
    order: np.ndarray
    example: np.ndarray
    owner: np.ndarray
    #: Whether a context has several parts.
    split: bool

    def cuts(self, buckets: int) -> list[tuple[int, slice, slice]]:
        """(bucket, its parts, their grams) for each bucket that is asked."""
        cuts = _cuts(self.keys, buckets)
        ends = np.searchsorted(self.gram_part, [y for _, _, y in cuts]).tolist()
        return [(b, slice(x, y), slice(g, h)) for (b, x, y), g, h in zip(cuts, [0, *ends], ends)]


def _lengths(cuts: list[tuple[int, slice, slice]]) -> list[tuple[int, int, int]]:
    return [(b, p.stop - p.start, g.stop - g.start) for b, p, g in cuts]


class Chunk:
    """The symbols of a chunk, and what the answers so far say about each of its tokens."""

    def __init__(self, data: bytes, answers: Answers, known: int, buckets: int, split: int, scale: float, gain: float):
        """``data``: the chunk; ``known``: the length of context up to which there are answers; ``split``: as SPLIT."""
        self.ids, own = pickle.loads(data)
        train, self.sizes, every, number = _unpacked(own)
        self.buckets, self.split = buckets, split
        self.symbols, self.number = np.cumsum(every), number.astype(np.int64)
        #: The number of the context looked at last, which is given out by the chunk; and bits that hold any such number.
        self.shorter, self.bits = np.zeros(len(number), np.int64), len(number).bit_length()
        self.train = np.repeat(train, self.sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.count = answers.take(WORDS, [(b, 0, y - x) for b, x, y in _cuts(self.symbols, buckets)])[0].astype(np.float64)
        self.root, self.gain, self.depth = (self.count + 0.5) / scale, gain, 0
        self.p = self.root.take(self.number)
        #: Of the context looked at last: whether it is a state, and how often it occurs with the token after it (-1: not asked).
        self.state = np.ones(len(number), bool)
        self.seen = self.count.take(self.number)
        for depth in range(1, known + 1):
            v = self.level(depth)
            if not len(v.at):
                break  # nor are there longer contexts
            self.learn(v, *answers.take(depth, _lengths(v.cuts(buckets))))
            self.depth = depth

    def level(self, depth: int) -> Level:
        """What to ask about contexts of ``depth`` words; those of fewer have been answered."""
        asked = self.state.copy()
        asked[self.begins[self.sizes >= depth] + depth - 1] = False  # has one word less before it
        frequent = self.seen >= LEAST
        asked[1:] &= frequent[:-1] | (self.seen[:-1] < 0)  # how often the context occurs: -1 where unknown
        at = np.flatnonzero(asked)
        if depth == 1:  # words have numbers
            before = self.number.take(at - 1)
            used = np.zeros(len(self.symbols), bool)
            used[before] = True
            words = np.flatnonzero(used)
            context, often = (np.cumsum(used) - 1).take(before), self.count[words]
            part_keys = self.symbols[words]
        else:
            _, example, context = _numbered(self.shorter.take(at) << self.bits | self.number.take(at - depth))
            example = at.take(example)
            often, part_keys = self.seen.take(example - 1), np.zeros(len(example), np.uint64)
            for word in range(depth, 0, -1):
                part_keys = part_keys * np.uint64(common.BASE) + self.symbols.take(self.number.take(example - word))
        self.shorter[at] = context
        part_keys = common.mixed(part_keys)
        parts = (1 + np.maximum(often, 0) // self.split).astype(np.int64)
        first = np.cumsum(parts) - parts
        split = len(parts) > 0 and int(parts.max()) > 1
        if split:
            owner = np.repeat(np.arange(len(parts)), parts)
            part_keys = np.where(parts[owner] > 1, common.mixed(part_keys[owner] + (np.arange(len(owner)) - first[owner]).astype(np.uint64)), part_keys[owner])
        order = np.argsort(part_keys)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        follows = np.flatnonzero(asked & frequent)
        after = self.shorter.take(follows)
        grams, example, gram = _numbered(after << self.bits | self.number.take(follows))
        owners, example = grams >> self.bits, follows.take(example)
        if split:
            part = first.take(owners)
            dealt = np.flatnonzero((parts > 1).take(owners))
            part[dealt] += (self.symbols[self.number[example[dealt]]] >> np.uint64(7)).astype(np.int64) % parts[owners[dealt]]
            part, by = _sorted(rank.take(part))
        else:  # grams are in order of their contexts: only the contexts change places
            number = np.bincount(owners, minlength=len(order))
            begins, number = (np.cumsum(number) - number)[order], number[order]
            part = np.repeat(np.arange(len(order)), number)
            by = np.arange(len(owners)) + np.repeat(begins - (np.cumsum(number) - number), number)
        return Level(at, context, follows, after, gram, part_keys[order], first, parts, rank, part, by, example, owners, split)

    def asks(self, depth: int, asked: Asked, last: bool) -> bytes | None:
        """Part keys, training counts, whether there are more parts, number of grams; symbol, count and probability of each gram, to ``asked``.

        With the ``last`` length goes what its answers need for the scores.
        """
        if self.depth != depth - 1:
            return self.kept(None) if last else None  # no context of one word less
        v = self.level(depth)
        n = np.repeat(np.bincount(v.context, self.train[v.at], len(v.first)).astype(np.uint64), v.parts)
        held = np.empty(len(n), np.uint64)
        held[v.part_of] = n
        grams = np.bincount(v.gram, self.train[v.follows], len(v.example)).astype(np.uint64)[v.order]
        example = v.example.take(v.order)
        follower = (self.symbols >> (np.uint64(64) - _FOLLOWER)).take(self.number.take(example))
        log = np.maximum(np.rint(np.log(self.p.take(example)) * _STEP), -32768).astype(np.int16)
        number = np.bincount(v.gram_part, minlength=len(v.keys)).astype(np.uint32)
        split = np.empty(len(n), bool)
        split[v.part_of] = np.repeat(v.parts > 1, v.parts)
        for b, p, g in v.cuts(self.buckets):
            asked.add(b, v.keys[p], held[p], split[p], number[p], follower[g], grams[g], log[g])
        return self.kept(v) if last else None

    def learn(self, v: Level, held: np.ndarray, own: np.ndarray, several: np.ndarray, gain: np.ndarray, grams: np.ndarray) -> None:
        """Take in the answers to ``level``: by part the context's count, the sum and number of frequent followers and their gain.

        Of a context in one part the bucket has made the test: the gain is infinite, or all is zero.
        """
        if v.split:
            add = lambda x: np.add.reduceat(x[v.part_of].astype(np.float64), v.first)
            whole = held[v.part_of[v.first]].astype(np.float64)
        else:
            add = lambda x: x.take(v.part_of).astype(np.float64)
            whole = add(held)
        own, several, gain = add(own), add(several), add(gain)
        left = _left(whole, own, several)
        stays = _gained(whole, own, several, gain, left) >= self.gain
        self.p[v.at] *= np.where(stays, left, 1.0).take(v.context)
        n = np.empty(len(grams))
        n[v.order] = grams
        mass = np.where((n >= LEAST) & stays.take(v.owner), (n - DISCOUNT) / np.maximum(whole, 1).take(v.owner), 0.0)
        self.p[v.follows] += mass.take(v.gram)
        self.state = np.zeros(len(self.p), bool)
        self.state[v.at] = stays.take(v.context)
        # what was not asked is unknown, unless the context is known to be rare
        rare = (self.seen >= 0) & (self.seen < LEAST)
        self.seen = np.full(len(self.p), -1.0)
        self.seen[1:][rare[:-1]] = 0
        self.seen[v.at] = 0
        self.seen[v.follows] = n.take(v.gram)

    def kept(self, v: Level | None) -> bytes:
        """For each text its tokens, known tokens, and log10 of its probability at the root and as far as it is known; and the level, numbered as its answers come."""
        total = lambda x: np.add.reduceat(x, self.begins)
        sums = [self.sizes, total((self.count > 0).astype(np.int64).take(self.number)), total(np.log10(self.root).take(self.number)), total(np.log10(self.p))]
        if v is None or not len(v.at):
            return pickle.dumps((self.ids, _packed(*sums), None, None))
        inside, own = np.zeros(len(self.p), bool), np.zeros(len(self.p), bool)
        inside[v.at], own[v.follows] = True, True
        place = np.empty(len(v.order), np.uint32)
        place[v.order] = np.arange(len(place), dtype=np.uint32)
        context = v.context if v.split else v.part_of.take(v.context)
        level = [np.packbits(inside), np.packbits(own), context.astype(np.uint32), place.take(v.gram), self.p.take(v.example.take(v.order))]
        return pickle.dumps((self.ids, _packed(*sums), _packed(*level, *([v.parts.astype(np.uint32), v.part_of.astype(np.uint32)] if v.split else [])), _packed(*np.array(list(zip(*_lengths(v.cuts(self.buckets)), strict=True)), np.int64))))


def _scores(kept: bytes, answers: Answers, depth: int, least: float) -> tuple:
    """ids, tokens, known tokens, log10 at the root and in the tree, once the last length's answers are there."""
    ids, sums, level, lengths = pickle.loads(kept)
    sizes, known, base, score = _unpacked(sums)
    if level is None:
        return ids, sizes, known, base, score
    inside, own_mass, context, gram, before, *split = _unpacked(level)
    cuts = list(zip(*(x.tolist() for x in _unpacked(lengths)), strict=True))
    whole, own, several, gain, n = (x.astype(np.float64) for x in answers.take(depth, cuts))
    if split:
        parts, part_of = (x.astype(np.int64) for x in split)  # unsigned ones would sum to places that numpy does not take
        first = np.cumsum(parts) - parts
        whole, own, several, gain = whole[part_of[first]], *(np.add.reduceat(x[part_of], first) for x in (own, several, gain))
    left = _left(whole, own, several)
    stays = _gained(whole, own, several, gain, left) >= least
    size = int(sizes.sum())
    at = np.flatnonzero(np.unpackbits(inside, count=size))
    change = np.where(stays, np.log10(left), 0.0)[context]
    follows = np.flatnonzero(np.unpackbits(own_mass, count=size)[at])
    state = context[follows]
    hit = (n[gram] >= LEAST) & stays[state]
    state, gram = state[hit], gram[hit]
    # a gram's probability from the suffix is the same wherever it stands
    change[follows[hit]] = np.log10(left[state] + (n[gram] - DISCOUNT) / whole[state] / before[gram])
    return ids, sizes, known, base, score + np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at], change, len(sizes))


def _rows_of(table) -> list[tuple[int, int, bytes]]:
    return list(zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True))


def _packed_asks(keys, held, split, number, follower, grams, log) -> bytes:
    # followers of a part are in order, so that differences need fewer of the five bytes
    planes = _steps(follower).view(np.uint8).reshape(-1, 8)[:, :5]
    return _packed(_steps(keys), held, split, number, *np.ascontiguousarray(planes.T), grams, log)


def _asking(depth: int, buckets: int, split: int, scale: float, gain: float, last: bool):
    def run(key, table):
        rows, asked, out = _rows_of(table), Asked(), []
        answers = Answers(rows)
        for place, data in enumerate(_texts(rows)):
            kept = Chunk(data, answers, depth - 1, buckets, split, scale, gain).asks(depth, asked, last)
            if last:
                out.append((KEPT, place, kept))
        out += asked.rows(depth, _packed_asks)
        return pa.Table.from_batches([_batch([(key[0].as_py(), *a) for a in out])], _ROWS_SCHEMA)

    return run


def _left(whole: np.ndarray, own: np.ndarray, several: np.ndarray) -> np.ndarray:
    """The share of contexts' mass that goes to their suffixes."""
    return np.where(several > 0, 1 - (own - DISCOUNT * several) / np.maximum(whole, 1), 1.0)


def _gained(whole: np.ndarray, own: np.ndarray, several: np.ndarray, won: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Gain of contexts over their suffixes: what frequent followers win, less what the others lose; none without such followers."""
    return np.where(several > 0, won + (whole - own) * np.log(left), -np.inf)


def _answering(gain: float):
    return lambda table: _answered(table, gain)


def _answered(table, gain):
    """A bucket's answers: counts of parts and of grams in the training texts of all groups, and what the parts gain."""
    rows = list(zip(*(table[n].to_pylist() for n in ("group_id", "kind", "bucket")), strict=True))
    asked = [_unpacked(d) for d in table["data"].to_pylist()]
    column = lambda i: np.concatenate([a[i] for a in asked])
    keys, _, of = _numbered(np.concatenate([np.cumsum(a[0]) for a in asked]))
    whole = np.bincount(of, column(1), len(keys))
    split = np.zeros(len(keys), bool)
    split[of] = column(2)
    followers = [sum((a[4 + byte].astype(np.uint64) << np.uint64(8 * byte) for byte in range(5)), np.zeros(len(a[4]), np.uint64)) for a in asked]
    follower = np.concatenate([np.cumsum(f) & ((np.uint64(1) << _FOLLOWER) - np.uint64(1)) for f in followers])
    grams, example, gram = _numbered((np.repeat(of, column(3)).astype(np.uint64) << _FOLLOWER) | follower)
    n = np.bincount(gram, column(9), len(grams))
    often = n >= LEAST
    part, times = (grams[often] >> _FOLLOWER).astype(np.int64), n[often]
    own, several = np.bincount(part, times, len(keys)), np.bincount(part, minlength=len(keys))
    won = np.bincount(part, times * (np.log((times - DISCOUNT) / whole[part]) - column(10)[example[often]] / _STEP), len(keys))
    n = np.where(often, n, 0).astype(np.uint64)[gram]
    # what a group need not know is zero, and takes no room
    stays = _gained(whole, own, several, won, _left(whole, own, several)) >= gain
    told = split | stays
    by_part = [np.where(told, x, 0).astype(np.uint64) for x in (whole, own, several)]
    by_part.append(np.where(split, won, np.where(stays, np.inf, 0)).astype(np.float32))
    out, at, g = [], 0, 0
    for row, a in zip(rows, asked, strict=True):
        mine = of[at : at + len(a[0])]
        out.append((*row, _packed(*(x[mine] for x in by_part), n[g : g + len(a[4])])))
        at, g = at + len(a[0]), g + len(a[4])
    return pa.Table.from_batches([_batch(out)], _ROWS_SCHEMA)


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(depth: int, gain: float):
    def run(table):
        rows = _rows_of(table)
        answers = Answers(rows)
        found = [_scores(kept, answers, depth, gain) for kept in _texts(rows, KEPT)]
        return pa.concat_tables([pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SCORED, strict=True)], schema=_SCORED) for columns in found])

    return run


def score_texts(docs: DataFrame, folds: int = 5, held_out: int = 1, depth: int = DEPTH, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; learns from ids outside the fold."""
    spark = docs.sparkSession
    rows = common.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(common.partitions(spark), size // BUCKET_BYTES)
    store = common.Buckets(spark, f"{common.shared_dir(spark)}/scratch/{uuid.uuid4().hex}", _ROWS, "group_id", min(FILES, max(common.partitions(spark), size // FILE_BYTES)))

    def kept(df: DataFrame, part: str) -> None:
        store.write(df.repartition(store.files, "group_id"), part)

    train = F.coalesce(common.crc_remainder("doc_id", folds) != held_out, F.lit(False))
    kept(rows.withColumn("train", train).mapInArrow(_chunked(CHUNK_WORDS, min(TOGETHER, max(1, size // GROUP_BYTES))), _ROWS), "text")
    parts = ["text", "words"]
    with store.read(parts[:1]) as texts:
        kept(texts.groupBy("group_id").applyInArrow(_asked_words(buckets), _ROWS).groupBy("bucket").applyInArrow(_counted_words, _ROWS), "words")
    sums = spark.read.schema(_ROWS).parquet(store.folder("words")).filter(F.col("group_id") < 0).groupBy("kind").agg(F.sum("bucket")).collect()
    total, distinct = (next((n for k, n in sums if k == kind), 0) for kind in (TOTAL, DISTINCT))
    scale = total + 0.5 * (distinct + 1)
    sql = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    for words in range(1, depth + 1):
        last = words == depth
        with store.read(parts) as known:
            asked = known.filter(F.col("group_id") >= 0).groupBy("group_id").applyInArrow(_asking(words, buckets, SPLIT, scale, gain, last), _ROWS)
            if not last:
                kept(asked.groupBy("bucket").applyInArrow(_answering(gain), _ROWS), str(words))
                parts.append(str(words))
            else:  # written where the groups lie, so that these can go
                store.write(asked, "asked")
    for part in parts:
        common.remove(spark, store.folder(part))
    with store.read(["asked"]) as asked:
        kept(asked.filter(F.col("kind") != KEPT).groupBy("bucket").applyInArrow(_answering(gain), _ROWS), "answers")
    with store.read(["asked", "answers"]) as known:
        rows = known.filter((F.col("part") == "answers") | (F.col("kind") == KEPT))
        found = common.durable(rows.groupBy("group_id").applyInArrow(_scored(depth, gain), sql))
    common.remove(spark, store.path)
    return found.select(
        "doc_id",
        F.coalesce(common.crc_remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
