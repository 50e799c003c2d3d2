"""A plain simulator of bounded flow tables, written on its own: whole tables, a scan for expired flows at every packet."""

from __future__ import annotations

from tallyweir.policies.engine import CounterRng, Xorshift32


def fnv(text):
    h = 2166136261
    for c in text.encode():
        h = (h ^ c) * 16777619 % 2**32
    return h


def canonical(p):
    a, b = (p["src"], p["sport"]), (p["dst"], p["dport"])
    a, b = min(a, b), max(a, b)
    return (*a, *b, p["proto"])


def bucket_hash(key):
    wire = lambda n: int.from_bytes(n.to_bytes(4, "little"), "big")
    return fnv("%08x%04x%08x%04x%02x" % (wire(key[0]), key[1], wire(key[2]), key[3], key[4]))


def features(f, n):
    t, s = [x / 1e6 for x in f["ts"][:n]], [abs(x) for x in f["len"][:n]]
    return t, s


def simulate(packets, policy, buckets, aux_buckets, cap, first_n, idle, seed=1, rng="counter", score=None, evict_start=30):
    """(flows, collisions): flows as (key, count, wins, reason, table, first ts, offsets, lengths)."""
    draws = CounterRng(seed) if rng == "counter" else Xorshift32(seed)
    tables, aux, known = {}, {}, {}
    flows, log = [], []
    two = policy.startswith("duel")
    shared = policy in ("drop_challenger", "reservoir_shared", "protected", "duel_shared")
    gate = policy in ("fcfs", "reservoir", "random", "weighted", "random_replicate", "duel_gated", "duel_revised", "duel_even", "duel_logged")
    pure = policy in ("random", "weighted")
    keep_full = policy in ("drop_challenger", "reservoir_shared", "protected")

    def new(p):
        return {"key": canonical(p), "client": (p["src"], p["sport"]), "ts": [], "len": [], "wins": 0, "seen": 1, "udp": p["proto"] == 17, "last": p["ts"] // 10**6, "fin": set(), "long": None}

    def out(f, reason, table="main"):
        flows.append((f["key"], len(f["ts"]), f["wins"], reason, table, f["ts"][0], tuple(t - f["ts"][0] for t in f["ts"]), tuple(f["len"])))

    def once(place, p):
        if p["proto"] != 17:
            return True
        seen = known.setdefault(place, set())
        if canonical(p) in seen:
            return False
        seen.add(canonical(p))
        return True

    for p in packets:
        now = p["ts"] // 10**6
        for place in [k for k, f in tables.items() if f["udp"] and now - f["last"] >= idle]:
            out(tables.pop(place), "idle")
        for place in [k for k, f in aux.items() if f["udp"] and now - f["last"] >= idle]:
            del aux[place]
        key = canonical(p)
        h = bucket_hash(key)
        shard = 0 if shared else p["proto"]
        slot = (shard, h % buckets)
        ring = (shard, h % min(buckets, aux_buckets)) if two else slot
        tcp = p["proto"] == 6
        syn = p["flags"] == 2 if pure else bool(p["flags"] & 2)
        f = tables.get(slot)
        where = tables
        if f is None:
            if (tcp and not syn) or (gate and not once(ring, p)):
                continue
            f = tables[slot] = new(p)
        elif f["key"] != key and two:
            where = aux
            f = aux.get(ring)
            if f is not None and f["key"] != key:
                if policy != "duel_revised" or not draws.draw(ring) & 1:
                    continue
                del aux[ring]
                f = None
            if f is None:
                if (tcp and not syn) or (gate and not once(ring, p)):
                    continue
                f = aux[ring] = new(p)
        elif f["key"] != key:
            takes, seen = False, 1
            if policy == "drop_challenger":
                continue
            if policy == "fcfs":
                f["wins"] += not tcp or syn
                continue
            if policy == "reservoir_shared":
                if not once(ring, p):
                    continue
                f["seen"] += 1
                if draws.draw(ring) % f["seen"]:
                    continue
                seen = tables.pop(slot)["seen"]
                if tcp and not syn:
                    continue
            elif policy == "protected":
                if f["long"]:
                    continue
                del tables[slot]
                if tcp and not syn:
                    continue
            else:
                if tcp and not syn:
                    continue
                if policy in ("random", "weighted"):
                    if not once(ring, p):
                        continue
                    d = draws.draw(ring)
                    n = len(f["ts"])
                    takes = d / 2**32 < (0.5 if policy == "random" or n < evict_start else 0.5 * (cap - n) / (cap - evict_start))
                    log.append((p["no"], *((key, f["key"], 0) if takes else (f["key"], key, 1))))
                elif policy == "reservoir":
                    takes = draws.draw(ring) % (f["wins"] + 2) == 0
                else:
                    takes = draws.draw(ring) % 2 == 0
                if not takes:
                    f["wins"] += policy != "random_replicate"
                    continue
                if policy in ("reservoir", "random_replicate") and not once(ring, p):
                    continue
            f = tables[slot] = new(p)
            f["seen"] = seen
        f["last"] = now
        if len(f["ts"]) < cap:
            f["ts"].append(p["ts"])
            f["len"].append(p["size"] if (p["src"], p["sport"]) == f["client"] else -p["size"])
            if policy == "protected" and len(f["ts"]) == first_n and f["long"] is None:
                f["long"] = score(*features(f, first_n))
        if tcp and p["flags"] & 1:
            f["fin"].add((p["src"], p["sport"]) == f["client"])
        if len(f["ts"]) == cap:
            if keep_full:
                if tcp and p["flags"] & 1 and len(f["fin"]) == 2:
                    out(tables.pop(slot), "fin")
            elif where is tables:
                out(tables.pop(slot), "cap")
                continue
            elif policy == "duel_revised":
                out(aux.pop(ring), "cap", "aux")
                continue
        if two and slot in tables and ring in aux:
            m, a = tables[slot], aux[ring]
            if m["key"] == a["key"] or len(a["ts"]) < first_n:
                continue
            if len(m["ts"]) < first_n:
                m["last"] = a["last"] = now
                tables[slot], aux[ring] = a, m
                continue
            votes = (None, None) if policy == "duel_even" else (score(*features(m, first_n)), score(*features(a, first_n)))
            stays = votes[0] if votes[0] != votes[1] else bool(draws.draw(ring) & 1)
            if policy == "duel_logged":
                log.append((p["no"], *((m["key"], a["key"], 1) if stays else (a["key"], m["key"], 0))))
            if not stays:
                a["last"] = now
                tables[slot] = a
            del aux[ring]
    for f in tables.values():  # the clock runs on after the last packet
        out(f, "idle" if f["udp"] else "eof")
    return flows, log


def three_probe(packets, buckets, aux_buckets, cap):
    """Both tables of the three-probe policy at the end: (table, key, stored, total)."""

    def mix(x):
        x = (x ^ x >> 16) * 0x7FEB352D % 2**32
        x = (x ^ x >> 15) * 0x846CA68B % 2**32
        return x ^ x >> 16

    def place(k, seed, size):
        wire = lambda n: int.from_bytes(n.to_bytes(4, "little"), "big")
        h = seed ^ mix(wire(k[0])) ^ mix(wire(k[2])) ^ mix(k[1] << 16 | k[3]) ^ mix(k[4])
        return mix(h) % size

    main, aux = [None] * buckets, [None] * aux_buckets
    for p in packets:
        k = (p["src"], p["sport"], p["dst"], p["dport"], p["proto"])
        spots = [place(k, s, buckets) for s in (0x1234ABCD, 0xBADC0FFE, 0xC001D00D)]
        hit = next((i for i in spots if main[i] is None or main[i][0] == k), None)
        if hit is not None:
            main[hit] = (k, min(cap, (main[hit] or (k, 0, 0))[1] + 1), (main[hit] or (k, 0, 0))[2] + 1)
            continue
        least = min(spots, key=lambda i: main[i][2])
        j = place(k, 0xDEADBEEF, aux_buckets)
        if aux[j] is None or aux[j][0] != k:
            aux[j] = (k, 1, 1)
        elif aux[j][2] < main[least][2]:
            aux[j] = (k, min(cap, aux[j][1] + 1), aux[j][2] + 1)
        else:
            main[least] = (k, min(cap, aux[j][1] + 1), aux[j][2] + 1)
    return sorted([("main", *e) for e in main if e] + [("aux", *e) for e in aux if e])


def gated_probe(packets, buckets, aux_buckets, cap, idle):
    """Flows of the gated probe tables: (table, key, stored, total, reason), by a look at a flow's three places for each packet. Each protocol has tables of its own."""
    protocols = {p["proto"] for p in packets}
    if len(protocols) > 1:
        return sorted(f for proto in protocols for f in gated_probe([p for p in packets if p["proto"] == proto], buckets, aux_buckets, cap, idle))

    def mix(x):
        x = (x ^ x >> 16) * 0x7FEB352D % 2**32
        x = (x ^ x >> 15) * 0x846CA68B % 2**32
        return x ^ x >> 16

    def place(k, seed, size):
        wire = lambda n: int.from_bytes(n.to_bytes(4, "little"), "big")
        return mix(seed ^ mix(wire(k[0])) ^ mix(wire(k[2])) ^ mix(k[1] << 16 | k[3]) ^ mix(k[4])) % size

    def spots(k):
        return [("main", place(k, 0xA1B2C3D4, buckets)), ("main", place(k, 0x1B2C3D4A, buckets)), ("aux", place(k, 0xC0FFEE11, aux_buckets))]

    slots, asked, out = {}, set(), []

    def emit(where, reason):
        f = slots.pop(where)
        out.append((where[0], f["key"], f["n"], f["all"], reason))

    for p in packets:
        k, now = canonical(p), p["ts"] // 10**6
        mine = spots(k)
        for where in mine:
            f = slots.get(where)
            if f and f["key"][4] == 17 and now - f["last"] >= idle:
                emit(where, "idle")
        where = next((w for w in mine if w in slots and slots[w]["key"] == k), None)
        if where is None:
            if k[4] == 17:
                if k in asked:
                    continue
                asked.add(k)
            elif not p["flags"] & 2:
                continue
            where = next((w for w in mine[:2] if w not in slots), mine[2])
            slots[where] = {"key": k, "n": 0, "all": 0, "last": now}
        f = slots[where]
        f["n"], f["all"], f["last"] = min(cap, f["n"] + 1), f["all"] + 1, now
        if f["n"] == cap:
            emit(where, "cap")
            continue
        if k[4] == 6 and p["flags"] & 1:
            emit(where, "fin")
            continue
        held = [slots[w]["n"] if w in slots else 0 for w in mine[:2]]
        small = mine[0] if held[0] <= held[1] else mine[1]
        if mine[2] in slots and slots[mine[2]]["n"] > min(held):
            up, down = slots.pop(mine[2]), slots.pop(small, None)
            slots[small], up["last"] = up, now
            if down:
                down["last"] = now
                theirs = spots(down["key"])
                other = theirs[1] if small == theirs[0] else theirs[0]
                slots[other if other not in slots else theirs[2]] = down
    for where in list(slots):
        emit(where, "idle" if slots[where]["key"][4] == 17 else "eof")
    return sorted(out)
