"""What fires and what is admitted, straight from the definitions over plain lists."""

MICROS = 1_000_000


def _within(times, now, seconds):
    return sum(now - seconds * MICROS <= t <= now for t in times)


def firing(rows, mode):
    """rows: (us, event_id, key, kind) in order; kind in ssh_fail, su_fail, accept, 4xx."""
    fired = set()
    for n, (now, event_id, key, kind) in enumerate(rows):
        upto = [(t, k) for t, _, other, k in rows[:n + 1] if other == key]
        ssh = [t for t, k in upto if k == "ssh_fail"]
        failures = [t for t, k in upto if k in ("ssh_fail", "su_fail")]
        refused = _within([t for t, k in upto if k == "4xx"], now, 60)
        before = _within(ssh, now, 300)
        if mode == "reference":
            # failures forgotten a minute before the last one; shared counters hold each row twice
            before = min(before, _within(ssh, ssh[-1], 60)) if ssh else 0
            low, high = 2 * refused - 1, 2 * refused
        else:
            low = high = refused
        reached = {
            "ssh_fail": {"AUTH-001": _within(ssh, now, 60) >= 5, "AUTH-005": _within(failures, now, 60) >= 10},
            "su_fail": {"AUTH-005": _within(failures, now, 60) >= 10},
            "accept": {"AUTH-006": before >= 3},
            "4xx": {"WEB-002": low >= 20, "WEB-004": high >= 50},
        }
        fired |= {(event_id, rule) for rule, yes in reached.get(kind, {}).items() if yes}
    return fired


def admitted(rows, limit, width):
    """rows: (us, event_id, source) in order; a row passes if the limit-th last one that passed
    for its source lies before the window."""
    passed = []
    for now, event_id, source in rows:
        mine = [t for t, _, s in passed if s == source]
        if len(mine) < limit or mine[-limit] < now - width:
            passed.append((now, event_id, source))
    return {event_id for _, event_id, _ in passed}
