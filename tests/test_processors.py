"""A bucket's keys are asked for together: state calls do not grow with the number of keys."""

from __future__ import annotations

import pandas as pd

from telemark.streaming.processors import CHUNK_KEYS, FirstArrival, SequenceTracker


class Counted:
    """Map or value state of one bucket that counts its calls."""

    def __init__(self):
        self.held, self.value, self.calls = {}, None, 0

    def _call(self, result=None):
        self.calls += 1
        return result

    def iterator(self):
        return self._call(iter(list(self.held.items())))

    def getValue(self, key):
        return self._call(self.held[key])

    def updateValue(self, key, value):
        self._call()
        self.held[key] = value

    def get(self):
        return self._call(self.value)

    def update(self, value):
        self._call()
        self.value = value


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Counted())

    getValueState = getMapState

    def calls(self):
        return sum(s.calls for s in self.states.values())


def test_first_arrivals_of_many_keys_take_few_state_calls():
    handle, step = Handle(), FirstArrival(["k"], ["delivery_id", "raw_body"])
    step.init(handle)
    first = {}
    for batch in range(4):
        ids = range(batch * 3000, batch * 3000 + 3000)
        rows = pd.DataFrame({
            "delivery_id": ids, "received_us": [i // 2 for i in ids], "raw_body": [b"%d" % i for i in ids],
            # every third row repeats a key of this or an earlier batch; every tenth has none
            "k": [f"k{i // 7 if i % 3 == 0 else i}" for i in ids], "keyed": [i % 10 != 0 for i in ids], "bucket": 5,
        })
        rows["key_hash"] = [hash(k) % 1000 for k in rows["k"]]  # hashes collide; records decide
        before = handle.calls()
        got = pd.concat(step.handleInputRows((5,), iter([rows.sample(frac=1.0, random_state=1)]), None))
        chunks = len(handle.states["records"].held)
        assert handle.calls() - before <= 1 + chunks + 2 * (3000 // CHUNK_KEYS + 2)
        for r in rows.itertuples():
            if r.keyed:
                first.setdefault(r.k, r.delivery_id)
        want = {r.delivery_id: first[r.k] if r.keyed else r.delivery_id for r in rows.itertuples()}
        assert dict(zip(got["delivery_id"], got["first_delivery_id"])) == want
        assert all(b == b"%d" % i for b, i in zip(got["first_raw_body"], got["first_delivery_id"]))
    sizes = [len(v[0]) // 8 for _, v in sorted(handle.states["hashes"].held.items())]
    assert sum(sizes) == len(first) and set(sizes[:-1]) == {CHUNK_KEYS}


def test_marks_of_many_sessions_take_two_state_calls():
    handle, step = Handle(), SequenceTracker()
    step.init(handle)
    for batch, want in ((0, ("FIRST", 3)), (1, ("GAP", 1)), (2, ("SEQUENCE_STATE_CONFLICT", 0))):
        number = {0: 3, 1: 5, 2: 5}[batch]
        rows = pd.DataFrame({
            "delivery_id": range(1000), "received_us": batch, "payload": 1, "boot": range(1000), "sequence": number,
            "keyed": [i % 10 != 0 for i in range(1000)], "bucket": 5,
        })
        before = handle.calls()
        got = pd.concat(step.handleInputRows((5,), iter([rows]), None))
        assert handle.calls() - before <= 2
        tracked = got["delivery_id"] % 10 != 0
        assert set(zip(got[tracked]["sequence_disposition"], got[tracked]["missing_before"])) == {want}
        assert got[~tracked]["sequence_disposition"].isna().all() and got[~tracked]["missing_before"].isna().all()
