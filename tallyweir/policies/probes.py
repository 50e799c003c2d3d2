"""Policies with several places per flow: main tables with probes, and an auxiliary table whose flows move up.

A flow's places couple the buckets, so the trace is one ordered stream per protocol group, through one task; its state is
the tables, whatever the length of the trace.
"""

from __future__ import annotations

from tallyweir.functions.keys import MASK, MIX_1, MIX_2
from tallyweir.policies.engine import Entry, Packet, Policy

# The seeds of the hash families.
PROBES, AUX_PROBE = (0x1234ABCD, 0xBADC0FFE, 0xC001D00D), 0xDEADBEEF
TWO_PROBES, GATED_AUX_PROBE = (0xA1B2C3D4, 0x1B2C3D4A), 0xC0FFEE11


def mix32(x: int) -> int:
    x = (x ^ x >> 16) * MIX_1 & MASK
    x = (x ^ x >> 15) * MIX_2 & MASK
    return x ^ x >> 16


def seeded(key: tuple, seed: int) -> int:
    """The hash of a flow key under a seed; addresses as numbers in wire order."""
    ip1, port1, ip2, port2, proto = key
    wire = lambda n: int.from_bytes(n.to_bytes(4, "big"), "little")
    h = seed
    for part in (wire(ip1), wire(ip2), port1 << 16 | port2, proto):
        h ^= mix32(part)
    return mix32(h)


class Tables:
    __slots__ = ("aux", "group", "known", "main")

    def __init__(self, group: tuple[int, int]):
        self.group, self.main, self.aux, self.known = group, {}, {}, set()


class ThreeProbe(Policy):
    """Three probes in the main table, else the auxiliary slot, whose flow is replaced by any other. A contender that has
    as many packets as the smallest probed flow is copied over it; its copy in the auxiliary table stays. Directions are
    flows of their own, nothing expires, and both tables are emitted at the end."""

    shared = whole = True

    def open(self, group: tuple[int, int]) -> Tables:
        return Tables(group)

    def packet(self, t: Tables, p: Packet) -> None:
        c = self.out.counts
        c["packets"] += 1
        key = (p.src, p.sport, p.dst, p.dport, p.proto)
        p.key = key
        least = place = None
        for seed in PROBES:
            i = seeded(key, seed) & self.s.buckets - 1
            e = t.main.get(i)
            if e is None or e.key == key:
                c["main_insert" if e is None else "main_hit"] += 1
                e = t.main.setdefault(i, Entry(p))
                e.add(p, self.s.cap)
                return
            c["main_collisions"] += 1
            if least is None or e.total < least:
                least, place = e.total, i
        j = seeded(key, AUX_PROBE) & self.s.aux_buckets - 1
        a = t.aux.get(j)
        if a is None or a.key != key:
            t.aux[j] = Entry(p)
            t.aux[j].add(p, self.s.cap)
            c["aux_replace"] += 1
        elif a.total < least:
            a.add(p, self.s.cap)
            c["aux_hit"] += 1
        else:
            up = Entry(p)
            up.client, up.server, up.times, up.lengths, up.count, up.total = a.client, a.server, list(a.times), list(a.lengths), a.count, a.total
            up.add(p, self.s.cap)
            t.main[place] = up
            c["promotions"] += 1

    def close(self, t: Tables) -> None:
        for name, table in (("main", t.main), ("aux", t.aux)):
            for i in sorted(table):
                self.out.flow(i, table[i], "eof", name)


class GatedProbe(Policy):
    """Two probes in the main table, else the auxiliary slot, which the newcomer overwrites. After each packet a contender
    that is larger than the smaller of its probed flows moves up; the flow it displaces goes to its other place if that
    is empty, else to its own auxiliary slot. TCP flows begin with a SYN and end with any FIN; UDP keys are let in once."""

    whole = True

    def open(self, group: tuple[int, int]) -> Tables:
        return Tables(group)

    def places(self, key: tuple) -> tuple[int, int, int]:
        return (*(seeded(key, s) & self.s.buckets - 1 for s in TWO_PROBES), seeded(key, GATED_AUX_PROBE) & self.s.aux_buckets - 1)

    def expire(self, t: Tables, now: int, at: list[tuple[dict, int]], names: list[str]) -> None:
        for (table, i), name in zip(at, names):
            if i in table and table[i].idle(now, self.s.idle):
                self.out.flow(i, table.pop(i), "idle", name)

    def packet(self, t: Tables, p: Packet) -> None:
        c = self.out.counts
        c["packets"] += 1
        one, two, g = self.places(p.key)
        self.expire(t, p.second, [(t.main, one), (t.main, two), (t.aux, g)], ["main", "main", "aux"])
        table, i = next(((tab, k) for tab, k in ((t.main, one), (t.main, two), (t.aux, g)) if k in tab and tab[k].key == p.key), (None, 0))
        if table is not None:
            c["matched"] += 1
        else:
            if not p.udp and not p.syn:
                c["mid_flow"] += 1
                return
            if p.udp:
                if p.key in t.known:
                    c["refused"] += 1
                    return
                t.known.add(p.key)
            table, i = (t.main, one) if one not in t.main else (t.main, two) if two not in t.main else (t.aux, g)
            if table is t.aux and g in t.aux:
                c["aux_overwritten"] += 1
            table[i] = Entry(p)
            c["inserted_main" if table is t.main else "inserted_aux"] += 1
        e = table[i]
        e.add(p, self.s.cap)
        if e.count == self.s.cap or (p.fin and not p.udp):
            self.out.flow(i, table.pop(i), "cap" if e.count == self.s.cap else "fin", "main" if table is t.main else "aux")
            return
        sizes = [t.main[k].count if k in t.main else 0 for k in (one, two)]
        place = two if sizes[1] < sizes[0] else one
        if g in t.aux and t.aux[g].count > min(sizes):
            up, down = t.aux.pop(g), t.main.get(place)
            t.main[place] = up
            up.last = p.second
            c["promotions"] += 1
            if down is not None:
                a, b, own = self.places(down.key)
                other = b if place == a else a
                if other not in t.main:
                    t.main[other] = down
                else:
                    t.aux[own] = down
                    c["demotions"] += 1
                down.last = p.second

    def close(self, t: Tables) -> None:
        for name, table in (("main", t.main), ("aux", t.aux)):
            for i in sorted(table):
                self.out.flow(i, table[i], "idle" if table[i].udp else "eof", name)
