"""BCJ2: x86 branch targets in streams of their own, with a range coder that says where they are."""

from __future__ import annotations

import re
import struct

from foldlake.functions.errors import corrupted

# The range coder's scale.
MODEL_BITS, MOVE_BITS, TOP = 11, 5, 1 << 24

#: A call, a jump, or the second byte of a conditional one.
_BRANCH = re.compile(rb"[\xe8\xe9]|(?<=\x0f)[\x80-\x8f]", re.DOTALL)


def _model(before: int, byte: int) -> int:
    """Which probability: one for each byte before a call, one for jumps, one for conditional ones."""
    return before if byte == 0xE8 else 256 if byte == 0xE9 else 257


def decode(inputs: list[bytes], size: int) -> bytes:
    """main, call, jump and range-coder streams to the code of `size` bytes."""
    main, call, jump, coded = inputs
    if len(coded) < 5:
        raise corrupted("BCJ2's range coder stream is cut short")
    models = [1 << (MODEL_BITS - 1)] * 258
    span, code, rc = 0xFFFFFFFF, int.from_bytes(coded[1:5], "big"), 5
    out, at, calls, jumps, before = bytearray(), 0, 0, 0, 0
    while len(out) < size:
        if at >= len(main):
            raise corrupted("BCJ2's main stream is cut short")
        # behind a target, what stands before a byte isn't in the main stream
        m = None if before == 0x0F and main[at] & 0xF0 == 0x80 else _BRANCH.search(main, at)
        stop = at + 1 if before == 0x0F and main[at] & 0xF0 == 0x80 else m.end() if m else len(main)
        fresh = main[at : min(stop, at + size - len(out))]
        if len(fresh) > 1:
            before = fresh[-2]
        out += fresh
        at += len(fresh)
        byte = fresh[-1]
        if at < stop or (m is None and stop == len(main) and not (byte & 0xF0 == 0x80 and before == 0x0F)):
            if len(out) < size:
                raise corrupted("BCJ2's main stream is cut short")
            break
        if len(out) == size:
            break
        k = _model(before, byte)
        bound = (span >> MODEL_BITS) * models[k]
        if code < bound:
            span = bound
            models[k] += ((1 << MODEL_BITS) - models[k]) >> MOVE_BITS
            taken = False
        else:
            code, span = code - bound, span - bound
            models[k] -= models[k] >> MOVE_BITS
            taken = True
        if span < TOP:
            if rc >= len(coded):
                raise corrupted("BCJ2's range coder stream is cut short")
            code, span, rc = (code << 8 | coded[rc]) & 0xFFFFFFFF, span << 8 & 0xFFFFFFFF, rc + 1
        before = byte
        if taken:
            source, k = (call, calls) if byte == 0xE8 else (jump, jumps)
            if k + 4 > len(source):
                raise corrupted("a stream of BCJ2's targets is cut short")
            calls, jumps = (calls + 4, jumps) if byte == 0xE8 else (calls, jumps + 4)
            target = (int.from_bytes(source[k : k + 4], "big") - (len(out) + 4)) & 0xFFFFFFFF
            part = struct.pack("<I", target)[: size - len(out)]
            out += part
            before = part[-1] if part else before
    return bytes(out)


def encode(data: bytes, reach: int = 1 << 26) -> list[bytes]:
    """main, call, jump and range-coder streams. Targets farther than `reach` stay where they are."""
    models = [1 << (MODEL_BITS - 1)] * 258
    main, call, jump, coded = bytearray(), bytearray(), bytearray(), bytearray()
    low, span, cache, pending = 0, 0xFFFFFFFF, 0, 1

    def shift() -> None:
        nonlocal low, cache, pending
        if low < 0xFF000000 or low > 0xFFFFFFFF:
            carry = low >> 32
            while pending:
                coded.append((cache + carry) & 0xFF)
                cache, pending = 0xFF, pending - 1
            cache = low >> 24 & 0xFF
        pending += 1
        low = (low & 0x00FFFFFF) << 8

    i = 0
    while i < len(data):
        m = _BRANCH.search(data, i)
        stop = m.end() if m else len(data)
        main += data[i:stop]
        i = stop
        if m is None or i == len(data):
            break
        byte, before = data[i - 1], data[i - 2] if i > 1 else 0
        taken = False
        if i + 4 <= len(data):
            offset = struct.unpack_from("<i", data, i)[0]
            taken = abs(offset) <= reach and 0 <= i + 4 + offset < max(len(data), 1)
        k = _model(before, byte)
        bound = (span >> MODEL_BITS) * models[k]
        if taken:
            low, span = low + bound, span - bound
            models[k] -= models[k] >> MOVE_BITS
        else:
            span = bound
            models[k] += ((1 << MODEL_BITS) - models[k]) >> MOVE_BITS
        if span < TOP:
            span = span << 8 & 0xFFFFFFFF
            shift()
        if taken:
            target = (struct.unpack_from("<I", data, i)[0] + i + 4) & 0xFFFFFFFF
            (call if byte == 0xE8 else jump).extend(target.to_bytes(4, "big"))
            i += 4
    for _ in range(5):
        shift()
    return [bytes(main), bytes(call), bytes(jump), bytes(coded)]
