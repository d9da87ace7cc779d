"""The ordered rules one record at a time, as plain statements to test against."""


def keys_of(record, key_sets):
    found = []
    for number, parts in enumerate(key_sets):
        values = [str(record[p]).strip().lower() if record[p] is not None else "" for p in parts]
        if all(values):
            found.append((number, tuple(values)))
    return found


def first_seen(records, key_sets, record_id="rid"):
    """{rid: (primary, key_set)}"""
    owner, out = {}, {}
    for record in sorted(records, key=lambda r: r[record_id]):
        keys = keys_of(record, key_sets)
        hit = next((k for k in keys if k in owner), None)
        if hit is None:
            out[record[record_id]] = (record[record_id], None)
            owner.update({k: record[record_id] for k in keys})
        else:
            out[record[record_id]] = (owner[hit], hit[0])
    return out


def components(records, key_sets, record_id="rid"):
    """{rid: smallest rid of its component}"""
    parent = {r[record_id]: r[record_id] for r in records}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holder = {}
    for record in records:
        for key in keys_of(record, key_sets):
            a, b = top(record[record_id]), top(holder.setdefault(key, record[record_id]))
            parent[max(a, b)] = min(a, b)
    return {r: top(r) for r in parent}


def fold(members, fields, ranking, record_id="rid"):
    """(base id, values) of one cluster."""
    base, values = None, {}
    for m in sorted(members, key=lambda r: r[record_id]):
        if base is None:
            base, values = m[record_id], {f: m[f] for f in fields}
            continue
        empty = lambda r: sum(r[f] is None for f in ranking)
        if empty(m) < empty(values):
            base, lead, rest = m[record_id], m, values
        else:
            lead, rest = values, m
        values = {f: lead[f] if lead[f] is not None else rest[f] for f in fields}
    return base, values
