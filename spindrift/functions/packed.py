"""The packets of an Arrow batch as one flat array of bytes, so that a field of all of them is read or written at once.

Places and numbers are int64 arrays with an entry a packet; -1 stands for none, as null does in a column. Batches are taken in
slices of SLICE bytes, so that working memory doesn't grow with the batch or the packets in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of packets that are worked on together.
SLICE = 4 << 20

RAW, ETHERNET = 101, 1
#: IPv6 headers that stand between the fixed header and the packet's protocol (RFC 8200 and its registry).
HOP_BY_HOP, ROUTING, FRAGMENT, AUTHENTICATION = 0, 43, 44, 51
EXTENSIONS = (HOP_BY_HOP, ROUTING, FRAGMENT, AUTHENTICATION, 60, 135, 139, 140)


def slices(data: pa.Array, *others: pa.Array):
    """(data, *others) in slices of SLICE bytes of data, or of one packet that is longer."""
    ends = np.frombuffer(data.cast(pa.large_binary()).buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else ()
    first = 0
    while first < len(data):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
        yield tuple(c.slice(first, last - first) for c in (data, *others))
        first = last


def sliced(work, data: pa.Array, *others: pa.Array) -> pa.Array:
    """``work(data, *others)`` slice by slice."""
    out = [work(*some) for some in slices(data, *others)]
    return pa.concat_arrays(out) if out else work(data, *others)


def runs(keys: pa.Array) -> list[tuple[int, int]]:
    """(first, end) of the stretches of equal neighbours; a null is unlike any other."""
    if not len(keys):
        return []
    same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(keys)]
    return list(zip(cuts, cuts[1:], strict=False))


def numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def column(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values < 0)


def after(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """``n`` bytes behind ``at``."""
    return np.where((at >= 0) & (np.asarray(n) >= 0), at + n, -1)


class Packed:
    def __init__(self, data: pa.Array):
        data = data.cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        body = data.buffers()[2]
        flat = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None and len(ends) else np.zeros(0, np.uint8)
        self.flat = np.concatenate([flat, np.zeros(8, np.uint8)])  # a copy that can be written, with room behind the end
        self.ends, self.nulls = ends - ends[:1].sum(), data.is_null().to_numpy(zero_copy_only=False)
        self.at, self.size = self.ends[:-1], np.where(self.nulls, -1, np.diff(self.ends))

    def number(self, at: np.ndarray, size: int, rows=slice(None)) -> np.ndarray:
        """Big-endian unsigned numbers of ``size`` bytes; none past a packet's end."""
        good = (at >= 0) & (at + size <= self.size[rows])
        place, out = np.where(good, self.at[rows] + at, 0), np.zeros(len(at), np.int64)
        for k in range(size):
            out = out * 256 + self.flat[place + k]
        return np.where(good, out, -1)

    def write(self, at: np.ndarray, pieces: np.ndarray) -> None:
        """Rows of bytes over those from ``at`` on, where they fit."""
        rows = np.flatnonzero((at >= 0) & (at + pieces.shape[1] <= self.size))
        self.flat[(self.at + at)[rows, None] + np.arange(pieces.shape[1])] = pieces[rows]

    def write_repeated(self, at: np.ndarray, size: np.ndarray, texts: Packed, most: int) -> None:
        """Texts, each repeated ``most`` times and cut to ``size``, over the bytes from ``at`` on, where they fit."""
        n = np.minimum(size, most * texts.size)
        rows = np.flatnonzero((at >= 0) & (n > 0) & (at + n <= self.size))
        n = n[rows]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.flat[np.repeat((self.at + at)[rows], n) + place] = texts.flat[np.repeat(texts.at[rows], n) + place % np.repeat(texts.size[rows], n)]

    def sums(self):
        """A function (at, size) to the sums of 16-bit words; an odd last byte is followed by a zero."""
        both = np.concatenate([[0], np.cumsum(self.flat, dtype=np.int64)])
        even = self.flat.astype(np.int64)
        even[1::2] = 0
        even = np.concatenate([[0], np.cumsum(even)])

        def words(at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
            start = self.at + np.clip(at, 0, np.maximum(self.size, 0))
            stop = np.maximum(start, self.at + np.minimum(at + size, self.size))
            one, every = even[stop] - even[start], both[stop] - both[start]
            high = np.where(start % 2 == 0, one, every - one)
            return np.where(at >= 0, high * 255 + every, -1)

        return words

    def array(self) -> pa.Array:
        nulls = pa.array(~self.nulls).buffers()[1] if self.nulls.any() else None
        return pa.Array.from_buffers(pa.binary(), len(self.at), [nulls, pa.py_buffer(self.ends.astype(np.int32)), pa.py_buffer(self.flat)])


def extension_chain(p: Packed, l3: np.ndarray) -> dict[str, np.ndarray]:
    """Protocol of IPv6 packets and where that header is, behind however many extension headers; not ``whole`` if a packet is
    one of several fragments (only the first has a header ``there``), ``rerouted`` if it has still to pass a router that
    its routing header names. A chain that the packet cuts short ends there."""
    proto, at = p.number(after(l3, 6), 1), after(l3, 40)
    whole, rerouted, there = np.ones(len(at), bool), np.zeros(len(at), bool), np.ones(len(at), bool)
    rows = np.flatnonzero(np.isin(proto, EXTENSIONS))
    while len(rows):  # a header has 8 bytes or more
        kind, here = proto[rows], at[rows]
        units = p.number(here + 1, 1, rows)
        size = np.where(kind == FRAGMENT, 8, np.where(units < 0, -1, np.where(kind == AUTHENTICATION, (units + 2) * 4, (units + 1) * 8)))
        more = (size > 0) & (here + size <= p.size[rows])
        rows, kind, here, size = rows[more], kind[more], here[more], size[more]
        offset, fragment = p.number(here + 2, 2, rows), kind == FRAGMENT
        proto[rows], at[rows] = p.number(here, 1, rows), here + size
        whole[rows] &= ~(fragment & (offset & 0xFFF9 != 0))
        rerouted[rows] |= (kind == ROUTING) & (p.number(here + 3, 1, rows) > 0)
        there[rows] = ~(fragment & (offset >= 8))
        rows = rows[there[rows] & np.isin(proto[rows], EXTENSIONS)]
    return {"proto": proto, "at": at, "whole": whole, "rerouted": rerouted, "there": there}


#: What ``headers`` finds besides the chain.
FIELDS = ("l3_at", "ip_version", "ip_ihl", "proto", "l3_len", "ip_ttl", "src_ip", "dst_ip", "l4_at", "sport", "dport", "tcp_seq", "tcp_ack", "flags", "tcp_window", "udp_len", "payload_at")


def headers(p: Packed, link: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Header fields, none where a layer isn't there, and the chains of IPv6 packets. VLAN tags are skipped."""
    ether, where = link == ETHERNET, lambda good, x: np.where(good, x, -1)
    tag = np.where(ether & (p.number(np.full(len(link), 12), 2) == 0x8100), 4, 0)
    l3 = np.where(link == RAW, 0, where(ether, 14 + tag))
    first = p.number(l3, 1)
    version = where(first >= 0, first >> 4)
    v4, v6 = version == 4, version == 6
    ihl, chain = where(v4, first & 15), extension_chain(p, where(v6, l3))
    proto = np.where(v4, p.number(after(l3, 9), 1), where(v6, chain["proto"]))
    l4 = np.where(v4, l3 + ihl * 4, where(v6 & chain["there"], chain["at"]))
    tcp, udp = proto == 6, proto == 17
    field = lambda good, at, n, size: where(good, p.number(after(at, n), size))
    words = field(tcp, l4, 12, 1)
    found = (
        l3, version, ihl, proto, np.where(v4, p.number(after(l3, 2), 2), np.where(v6, after(p.number(after(l3, 4), 2), 40), 0)),
        np.where(v4, p.number(after(l3, 8), 1), field(v6, l3, 7, 1)), field(v4, l3, 12, 4), field(v4, l3, 16, 4), l4, field(tcp | udp, l4, 0, 2), field(tcp | udp, l4, 2, 2),
        field(tcp, l4, 4, 4), field(tcp, l4, 8, 4), field(tcp, l4, 13, 1), field(tcp, l4, 14, 2), field(udp, l4, 4, 2), np.where(tcp, after(l4, where(words >= 0, (words >> 4) * 4)), where(udp, after(l4, 8))),
    )
    return dict(zip(FIELDS, found, strict=True)), chain


def server_names(p: Packed, payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the server name in a TLS client hello is and how long; all extensions are looked through."""
    hello = (p.number(payload, 1) == 0x16) & (p.number(after(payload, 5), 1) == 1)
    at = after(np.where(hello, payload, -1), 44)
    at = after(at, p.number(np.where(at >= 0, at - 1, -1), 1))
    at = after(after(at, 2), p.number(at, 2))
    at = after(after(at, 3), p.number(at, 1))
    size = p.number(np.where(at >= 0, at - 2, -1), 2)
    end, name = after(at, size), np.full(len(at), -1)
    rows = np.flatnonzero(end >= 0)
    while len(rows):
        here = at[rows]
        kind, n = p.number(here, 2, rows), p.number(here + 2, 2, rows)
        fits = here + 9 <= end[rows]
        found = fits & (kind == 0)
        name[rows[found]] = here[found] + 9
        rows, here, n = (x[fits & ~found & (n >= 0)] for x in (rows, here, n))
        at[rows] = here + 4 + n
    length = p.number(np.where(name >= 0, name - 2, -1), 2)
    return np.where(length >= 0, name, -1), length


def _internet_checksum(total: np.ndarray) -> np.ndarray:
    """The complement of the words' sum with carries added back."""
    folded = total % 65536 + total // 65536
    return 65535 - (folded % 65536 + folded // 65536)


def write_checksums(p: Packed, link: np.ndarray) -> None:
    """IPv4, TCP, UDP and (over IPv6) ICMPv6 checksums worked out anew, in place; see ``operators.frames.with_checksums``."""
    f, chain = headers(p, link)
    v4, proto = f["ip_version"] == 4, f["proto"]
    v6 = (f["ip_version"] == 6) & chain["whole"] & ~chain["rerouted"] & np.isin(proto, (6, 17, 58))
    l3_at, l4_at = np.where(v4 | v6, f["l3_at"], -1), np.where(v4 | v6, f["l4_at"], -1)
    l3 = np.where(v4, l3_at + 10, -1)
    l4 = after(l4_at, np.where(proto == 6, 16, np.where(proto == 17, 6, np.where(v6, 2, -1))))
    zeros = np.zeros((len(link), 2), np.uint8)
    p.write(l3, zeros)
    p.write(l4, zeros)
    words = p.sums()
    two = lambda x: np.stack([x >> 8, x & 255], 1).astype(np.uint8)
    head = _internet_checksum(words(l3_at, f["ip_ihl"] * 4))
    size = l3_at + f["l3_len"] - l4_at
    ends = np.where(v4, words(after(l3_at, 12), 8), words(after(l3_at, 8), 32))
    known = (l4_at >= 0) & (f["l3_len"] >= 0) & (proto >= 0)
    whole = _internet_checksum(np.where(known, words(l4_at, size) + ends + proto + size, 0))
    whole = np.where((proto == 17) & (whole == 0), 65535, whole)  # 0 would mean none
    p.write(l3, two(head))
    p.write(np.where(known, l4, -1), two(whole))


def records(ts_us: pa.Array, data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The records of a little-endian microsecond capture one after another, and where each begins (and the last ends)."""
    if ts_us.null_count or data.null_count:
        raise ValueError("a packet without a time or without data can't be written")
    p, ts = Packed(data), ts_us.cast(pa.int64()).to_numpy(zero_copy_only=False)
    if len(ts) and not 0 <= ts.min() <= ts.max() < 10**6 << 32:
        raise ValueError("a capture holds times from 1970 to 2106 only")
    bounds = p.ends - p.ends[:1].sum() + 16 * np.arange(len(p.ends))
    head = np.stack([ts // 10**6, ts % 10**6, p.size, p.size], 1).astype("<u4").view(np.uint8)
    out, body = np.empty(bounds[-1], np.uint8), np.ones(bounds[-1], bool)
    places = bounds[:-1, None] + np.arange(16)
    out[places], body[places] = head, False
    out[body] = p.flat[:-8]
    return out, bounds
