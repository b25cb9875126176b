"""The definitions in plain Python over a list of log rows, minute by minute."""

from __future__ import annotations

from collections import defaultdict

KPIS = ["min_dispatch", "min_accept", "min_wtp", "min_prep_time", "min_dt", "cpo", "cm0"]


def _minutes(start, end):
    return None if start is None or end is None else (end - start).total_seconds() / 60


def _second(ts):
    return None if ts is None else ts.hour * 3600 + ts.minute * 60 + ts.second


def top_stores(log, percentile):
    ids = defaultdict(set)
    for r in log:
        ids[r["store_address_id"]].add(r["order_id"])
    counts = {s: len(v - {None}) for s, v in ids.items()}
    ordered = sorted(counts.values())
    place = (len(ordered) - 1) * percentile
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    cutoff = ordered[low] + (ordered[high] - ordered[low]) * (place - low)
    return {s for s, n in counts.items() if n >= cutoff}


def detail(log, stores, open_hour=7, close_hour=21, times=None):
    """One dict per order row and ongoing minute, with concurrency and level.

    ``times`` are seconds of the day instead of every minute; then so is ``minute``.
    """
    grid = [(m * 60, m) for m in range(1440)] if times is None else [(t, t) for t in sorted(set(times))]
    rows = []
    for r in log:
        if r["store_address_id"] not in stores:
            continue
        start, end = _second(r["partner_dispatch_time_local"]), _second(r["pickup_time_local"])
        if start is None or end is None:
            continue
        act = r["activation_time_local"]
        measures = {
            "min_dispatch": _minutes(act, r["partner_dispatch_time_local"]),
            "min_accept": _minutes(r["partner_dispatch_time_local"], r["partner_accepted_time_local"]),
            "min_wtp": _minutes(r["enters_pickup_local"], r["pickup_time_local"]),
            "min_prep_time": _minutes(r["partner_accepted_time_local"], r["pickup_time_local"]),
            "min_dt": _minutes(act, r["delivery_time_local"]),
            "cpo": r["cpo"],
            "cm0": r["cm0"],
        }
        for time, minute in grid:
            if open_hour * 3600 <= time < close_hour * 3600 and start <= time < end:
                rows.append(
                    {
                        "store": r["store_address_id"],
                        "name": r["store_name"],
                        "order": r["order_id"],
                        "status": r["final_status"],
                        "date": None if act is None else act.date(),
                        "minute": minute,
                        "hour": time // 3600,
                        **measures,
                    }
                )
    cells, per_order = defaultdict(int), defaultdict(list)
    for d in rows:
        cells[d["store"], d["name"], d["date"], d["minute"]] += 1
    for d in rows:
        d["ongoing"] = cells[d["store"], d["name"], d["date"], d["minute"]]
        per_order[d["order"]].append(d["ongoing"])
    for d in rows:
        seen = per_order[d["order"]]
        d["level"] = round(sum(seen) / len(seen))
    return rows


def group(rows, keys):
    out = defaultdict(list)
    for d in rows:
        out[tuple(d[k] for k in keys)].append(d)
    return out


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def kpi_means(rows, keys):
    return {k: [mean([d[m] for d in ds]) for m in KPIS] for k, ds in group(rows, keys).items()}


def outcomes(rows, keys):
    def distinct(ds, status):
        return len({d["order"] for d in ds if d["status"] == status} - {None})

    return {
        k: (distinct(ds, "DeliveredStatus"), distinct(ds, "CanceledStatus")) for k, ds in group(rows, keys).items()
    }
