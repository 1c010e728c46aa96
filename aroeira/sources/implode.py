"""The compression of DBC bodies: Huffman-coded lengths and distances over literals.

Both follow the publicly described format.
"""

from __future__ import annotations

# Fixed values of the format: runs of code lengths (low four bits the length, the rest
# the repeats less one), copy length bases and extra bits.
_LENGTH_RUNS = (2, 35, 36, 53, 38, 23)
_DISTANCE_RUNS = (2, 20, 53, 230, 247, 151, 248)
_LITERAL_RUNS = (
    11, 124, 8, 7, 28, 7, 188, 13, 76, 4, 10, 8, 12, 10, 12, 10, 8, 23, 8, 9, 7, 6, 7, 8, 7, 6, 55, 8, 23, 24, 12, 11, 7, 9, 11, 12, 6, 7, 22, 5,
    7, 24, 6, 11, 9, 6, 7, 22, 7, 11, 38, 7, 9, 8, 25, 11, 8, 11, 9, 12, 8, 12, 5, 38, 5, 38, 5, 11, 7, 5, 6, 21, 6, 10, 53, 8, 7, 24, 10, 27,
    44, 253, 253, 253, 252, 252, 252, 13, 12, 45, 12, 45, 12, 61, 12, 45, 44, 173,
)
_BASE = (3, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 72, 136, 264)
_EXTRA = (0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8)
_END = 519


class BrokenStream(ValueError):
    pass


def _codes(runs: tuple[int, ...]) -> dict[tuple[int, int], int]:
    """(bits, code) -> symbol of the canonical code; codes are stored inverted."""
    lengths = [r & 15 for r in runs for _ in range((r >> 4) + 1)]
    out, code, before = {}, 0, 0
    for bits, symbol in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= bits - before
        out[bits, code ^ ((1 << bits) - 1)] = symbol
        code, before = code + 1, bits
    return out


_LENGTHS, _DISTANCES, _LITERALS = map(_codes, (_LENGTH_RUNS, _DISTANCE_RUNS, _LITERAL_RUNS))
_PEEK = 13


def _table(codes: dict[tuple[int, int], int]) -> list[int]:
    """For each value of the next 13 bits: 16 * symbol + bits of its code, or -1; a code's first bit is the lowest."""
    out = [-1] * (1 << _PEEK)
    for (bits, code), symbol in codes.items():
        first = int(f"{code:0{bits}b}"[::-1], 2)
        for rest in range(1 << (_PEEK - bits)):
            out[first | rest << bits] = symbol << 4 | bits
    return out


_LENGTH_TABLE, _DISTANCE_TABLE, _LITERAL_TABLE = map(_table, (_LENGTHS, _DISTANCES, _LITERALS))


def explode(data: bytes) -> bytes:
    """The bytes a compressed stream stands for."""
    if len(data) < 3:
        raise BrokenStream("the stream is too short")
    coded, window = data[0], data[1]
    if coded > 1 or not 4 <= window <= 6:
        raise BrokenStream("not a compressed stream")
    pool, held, at, end = 0, 0, 2, len(data)
    out = bytearray()
    while True:
        # a token takes at most 1 + 13 + 8 + 13 + 6 bits
        if held < 48:
            more = data[at : at + 16]
            pool |= int.from_bytes(more, "little") << held
            at += len(more)
            held += 8 * len(more)
        if not pool & 1:
            if coded:
                found = _LITERAL_TABLE[pool >> 1 & 0x1FFF]
                if found < 0:
                    raise BrokenStream("unknown code")
                out.append(found >> 4)
                used = 1 + (found & 15)
            else:
                out.append(pool >> 1 & 255)
                used = 9
            pool >>= used
            held -= used
            if held < 0:
                raise BrokenStream("the stream ends too early")
            continue
        pool >>= 1
        found = _LENGTH_TABLE[pool & 0x1FFF]
        if found < 0:
            raise BrokenStream("unknown code")
        s, bits = found >> 4, found & 15
        extra = _EXTRA[s]
        n = _BASE[s] + (pool >> bits & (1 << extra) - 1)
        pool >>= bits + extra
        held -= 1 + bits + extra
        if held < 0:
            raise BrokenStream("the stream ends too early")
        if n == _END:
            return bytes(out)
        found = _DISTANCE_TABLE[pool & 0x1FFF]
        if found < 0:
            raise BrokenStream("unknown code")
        low, bits = 2 if n == 2 else window, found & 15
        distance = ((found >> 4) << low | (pool >> bits & (1 << low) - 1)) + 1
        pool >>= bits + low
        held -= bits + low
        if held < 0:
            raise BrokenStream("the stream ends too early")
        if distance > len(out):
            raise BrokenStream("a copy from before the start")
        start = len(out) - distance
        if distance >= n:
            out += out[start : start + n]
        else:
            out += (bytes(out[start:]) * (n // distance + 1))[:n]


_WINDOW = 6
_REACH = 64 << _WINDOW
_LONGEST = _END - 1


def _emitted(codes: dict[tuple[int, int], int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (its code with the first bit lowest, bits)."""
    return {s: (int(f"{code:0{bits}b}"[::-1], 2), bits) for (bits, code), s in codes.items()}


_LENGTH_CODES, _DISTANCE_CODES = _emitted(_LENGTHS), _emitted(_DISTANCES)


def _copy_length(n: int) -> tuple[int, int]:
    """Bits (the copy mark first, lowest) and their number that stand for a copy of ``n`` bytes."""
    s = max((b, i) for i, b in enumerate(_BASE) if b <= n)[1]
    code, bits = _LENGTH_CODES[s]
    return 1 | code << 1 | (n - _BASE[s]) << (1 + bits), 1 + bits + _EXTRA[s]


_LENGTH_BITS = {n: _copy_length(n) for n in range(3, _END + 1)}


def implode(data: bytes) -> bytes:
    """A compressed stream: copies of what was seen within 4,096 bytes, plain literals, the end mark.

    The last place of each three bytes is tried, the longest copy from there is taken.
    """
    out = bytearray((0, _WINDOW))
    pool, held, at, end = 0, 0, 0, len(data)
    seen: dict[bytes, int] = {}
    while at < end:
        key = data[at : at + 3]
        before = seen.get(key, -1)
        seen[key] = at
        if len(key) == 3 and 0 <= before and at - before <= _REACH:
            n, most = 3, min(_LONGEST, end - at)
            while n < most and data[before + n : before + n + 16] == data[at + n : at + n + 16] and n + 16 <= most:
                n += 16
            while n < most and data[before + n] == data[at + n]:
                n += 1
            mark, bits = _LENGTH_BITS[n]
            pool |= mark << held
            held += bits
            distance = at - before - 1
            code, bits = _DISTANCE_CODES[distance >> _WINDOW]
            pool |= (code | (distance & (1 << _WINDOW) - 1) << bits) << held
            held += bits + _WINDOW
            for i in range(at + 1, min(at + n, at + 5)):  # the ends of a copy are enough to be found again
                seen[data[i : i + 3]] = i
            at += n
            for i in range(max(at - 4, 0), at):
                seen[data[i : i + 3]] = i
        else:
            pool |= data[at] << (held + 1)
            held += 9
            at += 1
        if held >= 64:
            out += (pool & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
            pool >>= 64
            held -= 64
    mark, bits = _LENGTH_BITS[_END]
    pool |= mark << held
    held += bits
    return bytes(out + pool.to_bytes(-(-held // 8), "little"))
