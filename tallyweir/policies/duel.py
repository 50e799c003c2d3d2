"""Policies of a main slot and an auxiliary one, where the contender collects packets until both can be judged."""

from __future__ import annotations

from tallyweir.policies.engine import Entry, Packet, Policy


class Ring:
    """An auxiliary slot with the main slots that share it."""

    __slots__ = ("aux", "group", "known", "mains")

    def __init__(self, group: tuple[int, int]):
        self.group, self.mains, self.aux, self.known = group, {}, None, set()


class Duel(Policy):
    """Model duel. A contender waits in the auxiliary slot; with n packets it takes the place of an incumbent that has
    fewer; when both have n the one that is predicted long stays, and a coin decides ties. The loser is gone.

    gate: UDP keys are let in once. third: what a third flow does, "drop" or "coin" (it takes the auxiliary slot by a
    coin). decide: "model" or "coin". emit_aux: a full contender is emitted too. When the main slot is emitted the
    contender is not moved up: its next packet asks for the empty main slot like any other.
    """

    gate, third, decide, emit_aux, log = False, "drop", "model", False, False

    def groups(self) -> int:
        return min(self.s.buckets, self.s.aux_buckets)

    def open(self, group: tuple[int, int]) -> Ring:
        return Ring(group)

    def coin(self, ring: Ring) -> bool:
        return bool(self.rng.draw(ring.group) & 1)

    def expire(self, ring: Ring, now: int) -> None:
        for slot, e in list(ring.mains.items()):
            if e.idle(now, self.s.idle):
                self.out.flow(slot, ring.mains.pop(slot), "idle")
        if ring.aux is not None and ring.aux.idle(now, self.s.idle):
            ring.aux = None
            self.out.counts["aux_idle"] += 1

    def packet(self, ring: Ring, p: Packet) -> None:
        c = self.out.counts
        c["packets"] += 1
        self.expire(ring, p.second)
        slot = p.hash & self.s.buckets - 1
        main, aux = ring.mains.get(slot), ring.aux
        in_aux = main is not None and main.key != p.key
        e = aux if in_aux else main
        if in_aux and aux is not None and aux.key != p.key:
            if self.third == "drop" or not self.coin(ring):
                c["third_dropped"] += 1
                return
            ring.aux = e = None  # gone before the newcomer is looked at
        if e is None:
            if not p.udp and not p.syn:
                return
            if self.gate and p.udp:
                if p.key in ring.known:
                    c["refused"] += 1
                    return
                ring.known.add(p.key)
            e = Entry(p)
            if in_aux:
                ring.aux = e
            else:
                ring.mains[slot] = e
            c["aux_inserted" if in_aux else "inserted"] += 1
        else:
            c["aux_matched" if in_aux else "matched"] += 1
        if e.add(p, self.s.cap):
            c["tracked"] += 1
        if e.count == self.s.cap:
            if not in_aux:
                self.out.flow(slot, ring.mains.pop(slot), "cap")
                return
            if self.emit_aux:
                self.out.flow(slot, e, "cap", "aux")
                ring.aux = None
                return
        if slot in ring.mains and ring.aux is not None:
            self.judge(ring, slot, p)

    def swap(self, ring: Ring, slot: int, now: int) -> None:
        ring.mains[slot], ring.aux = ring.aux, ring.mains[slot]
        for e in (ring.mains[slot], ring.aux):  # each gets a new deadline
            e.last = now
        self.out.counts["swaps"] += 1

    def judge(self, ring: Ring, slot: int, p: Packet) -> None:
        n, c = self.s.first_n, self.out.counts
        main, aux = ring.mains[slot], ring.aux
        if main.key == aux.key or aux.count < n:
            return
        if main.count < n:
            self.swap(ring, slot, p.second)
            return
        c["duels"] += 1
        for x in (main, aux):
            self.out.note(slot, "competed", x.key)
        keep_main = None
        if self.decide == "model":
            for x in (main, aux):
                self.out.note(slot, "classified", x.key)
            good, other = (self.keeps(x) for x in (main, aux))
            keep_main = good if good != other else None
        if keep_main is None:
            keep_main = self.coin(ring)
        c["main_wins" if keep_main else "aux_wins"] += 1
        if self.log:
            winner, loser = (main, aux) if keep_main else (aux, main)
            self.out.collision(slot, p, winner.key, loser.key, keep_main)
        if not keep_main:
            self.swap(ring, slot, p.second)
        ring.aux = None

    def keeps(self, e: Entry) -> bool:
        self.out.counts["scored"] += 1
        try:
            return self.score(e.features(self.s.first_n)) >= 0.5
        except (ArithmeticError, ValueError):
            return True  # a model that fails keeps the flow

    def close(self, ring: Ring) -> None:
        for slot in sorted(ring.mains):
            self.out.flow(slot, ring.mains[slot], "idle" if ring.mains[slot].udp else "eof")


class SharedDuel(Duel):
    """One pair of tables for both protocols."""

    shared = True


class GatedDuel(Duel):
    """With the once-only gate."""

    gate = True


class RevisedDuel(GatedDuel):
    """A third flow may take the auxiliary slot, and full contenders are emitted."""

    third, emit_aux = "coin", True


class EvenDuel(GatedDuel):
    """A coin decides every duel. Several main slots may share an auxiliary one."""

    decide = "coin"


class LoggedDuel(GatedDuel):
    """Duels are logged as collisions."""

    log = True
