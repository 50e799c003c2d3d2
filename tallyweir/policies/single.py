"""Policies of one slot per bucket: what a flow does that finds its bucket taken."""

from __future__ import annotations

from tallyweir.policies.engine import Entry, Packet, Policy


class Slot:
    """A bucket: its incumbent, and the UDP keys that were let in before."""

    __slots__ = ("entry", "group", "known")

    def __init__(self, group: tuple[int, int]):
        self.group, self.entry, self.known = group, None, set()


class SingleSlot(Policy):
    """Empty slots take flows, incumbents take their own packets; `meet` decides the rest.

    gate: UDP keys are let in once only. pure: a TCP flow needs a SYN without other flags. at_cap: a full flow is emitted
    at once; else a TCP flow waits for a FIN of both sides, and a UDP flow for quiet.
    """

    gate, pure, at_cap = True, False, True

    def open(self, group: tuple[int, int]) -> Slot:
        return Slot(group)

    def starts(self, p: Packet) -> bool:
        return p.udp or (p.pure_syn if self.pure else p.syn)

    def first_time(self, slot: Slot, p: Packet) -> bool:
        """Whether a UDP key was never asked about before; asking notes it."""
        if not p.udp or p.key not in slot.known:
            if p.udp:
                slot.known.add(p.key)
            return True
        self.out.counts["refused"] += 1
        return False

    def admit(self, slot: Slot, p: Packet) -> bool:
        if not self.starts(p):
            self.out.counts["mid_flow"] += 1
            return False
        return not self.gate or self.first_time(slot, p)

    def meet(self, slot: Slot, p: Packet) -> int | None:
        """A packet of another flow: None if it is dropped, else the contender count of the flow that takes over."""
        raise NotImplementedError

    def replace(self, slot: Slot, p: Packet, seen: int = 1) -> None:
        slot.entry = Entry(p, seen)
        self.out.counts["inserted"] += 1

    def packet(self, slot: Slot, p: Packet) -> None:
        c = self.out.counts
        c["packets"] += 1
        e = slot.entry
        if e is not None and e.idle(p.second, self.s.idle):
            self.emit(slot, "idle")
            e = None
        if e is None:
            if not self.admit(slot, p):
                return
            self.replace(slot, p)
        elif e.key == p.key:
            c["matched"] += 1
        else:
            seen = self.meet(slot, p)
            if seen is None:
                return
            self.replace(slot, p, seen)
        e = slot.entry
        if e.add(p, self.s.cap):
            c["tracked"] += 1
            self.stored(e)
        both = p.fin and not p.udp and e.fin(p)
        if e.count == self.s.cap and (self.at_cap or both):
            self.emit(slot, "cap" if self.at_cap else "fin")

    def stored(self, e: Entry) -> None:
        """A packet has been stored."""

    def emit(self, slot: Slot, reason: str) -> None:
        self.out.flow(slot.group[1], slot.entry, reason)
        slot.entry = None

    def close(self, slot: Slot) -> None:
        if slot.entry is not None:  # the clock runs on after the last packet
            self.emit(slot, "idle" if slot.entry.udp else "eof")


class DropChallenger(SingleSlot):
    """The newcomer's packet is dropped and counted, whatever it is."""

    shared, gate, at_cap = True, False, False

    def meet(self, slot: Slot, p: Packet) -> None:
        self.out.counts["collisions"] += 1


class FirstCome(SingleSlot):
    """The incumbent stays and scores a win; a TCP packet in mid-flow is a collision but no win."""

    def meet(self, slot: Slot, p: Packet) -> None:
        self.out.counts["collisions"] += 1
        if self.starts(p):
            self.out.counts["incumbent_wins"] += 1
            slot.entry.wins += 1


class ReservoirShared(SingleSlot):
    """The nth contender of a bucket takes it with probability 1/n. A UDP key contends once. The incumbent goes before
    the newcomer's SYN is looked at, so a mid-flow packet can leave the slot empty."""

    shared, gate, at_cap = True, False, False

    def meet(self, slot: Slot, p: Packet) -> int | None:
        c = self.out.counts
        c["collisions"] += 1
        if not self.first_time(slot, p):
            return None
        n = slot.entry.seen = slot.entry.seen + 1
        if self.rng.draw(slot.group) % n:
            c["incumbent_wins"] += 1
            return None
        c["challenger_wins"] += 1
        slot.entry = None
        if not self.starts(p):
            c["mid_flow"] += 1
            return None
        return n


class Reservoir(SingleSlot):
    """The newcomer wins with probability 1/(wins + 2); it is drawn before the once-only gate is asked."""

    def meet(self, slot: Slot, p: Packet) -> int | None:
        c = self.out.counts
        c["collisions"] += 1
        if not self.starts(p):
            return None
        if self.rng.draw(slot.group) % (slot.entry.wins + 2):
            c["incumbent_wins"] += 1
            slot.entry.wins += 1
            return None
        if not self.first_time(slot, p):
            return None
        c["challenger_wins"] += 1
        return 1


class RandomChance(SingleSlot):
    """Even odds. The gate is asked before the draw, so a UDP newcomer that loses is refused later. Collisions are logged."""

    pure = True

    def challenger_wins(self, e: Entry, draw: int) -> bool:
        return draw < 1 << 31

    def eligible(self, slot: Slot, p: Packet) -> bool:
        return self.starts(p) and self.first_time(slot, p)

    def meet(self, slot: Slot, p: Packet) -> int | None:
        if not self.eligible(slot, p):
            return None
        c, e = self.out.counts, slot.entry
        c["collisions"] += 1
        if self.wins(slot):
            c["challenger_wins"] += 1
            self.out.collision(slot.group[1], p, p.key, e.key, False)
            return 1
        c["incumbent_wins"] += 1
        e.wins += 1
        self.out.collision(slot.group[1], p, e.key, p.key, True)
        return None

    def wins(self, slot: Slot) -> bool:
        return self.challenger_wins(slot.entry, self.rng.draw(slot.group))


class WeightedChance(RandomChance):
    """Even odds up to evict_start packets, then falling to none at the cap."""

    def challenger_wins(self, e: Entry, draw: int) -> bool:
        if e.count < self.s.evict_start:
            chance = 0.5
        else:
            chance = 0.5 * (self.s.cap - e.count) / (self.s.cap - self.s.evict_start)
        return draw / 4294967296 < chance

    def wins(self, slot: Slot) -> bool:
        return slot.entry.count < self.s.cap and super().wins(slot)


class RandomReplicate(SingleSlot):
    """Even odds for repeated runs: any SYN starts a flow, the draw comes before the gate, nothing is logged."""

    def meet(self, slot: Slot, p: Packet) -> int | None:
        c = self.out.counts
        if not self.starts(p):
            return None
        c["collisions"] += 1
        if self.rng.draw(slot.group) % 2:
            c["incumbent_wins"] += 1
            return None
        if not self.first_time(slot, p):
            return None
        c["challenger_wins"] += 1
        return 1


class Protected(SingleSlot):
    """An incumbent that is predicted to be long at its nth packet stays; others go at once, before the newcomer's SYN is
    looked at."""

    shared, gate, at_cap = True, False, False

    def stored(self, e: Entry) -> None:
        if e.count == self.s.first_n and e.protected is None:
            e.protected = self.score(e.features(self.s.first_n)) >= 0.5
            self.out.counts["scored"] += 1

    def meet(self, slot: Slot, p: Packet) -> int | None:
        c = self.out.counts
        c["collisions"] += 1
        if slot.entry.protected:
            c["incumbent_wins"] += 1
            return None
        c["challenger_wins"] += 1
        slot.entry = None
        if not self.starts(p):
            c["mid_flow"] += 1
            return None
        return 1
