"""How often the event memory calls its state store, and that nothing stays in it without a timer."""

from types import SimpleNamespace

from pyspark.sql import Row

from briefloom.streaming.memory import EventMemory


class Store:
    def __init__(self):
        self.held, self.calls = {}, 0

    def _called(self):
        self.calls += 1

    def exists(self):
        self._called()
        return bool(self.held)

    def getValue(self, key):
        self._called()
        return self.held.get(key)

    def updateValue(self, key, value):
        self._called()
        self.held[key] = value

    def removeKey(self, key):
        self._called()
        self.held.pop(key, None)

    def iterator(self):
        self._called()
        return iter(list(self.held.items()))


def row(i, day):
    return Row(event_id=i, fingerprint=f"f{i}", at=day * 86_400_000_000, day=day, now_micros=day * 86_400_000_000 + 1, now_day=day, version=str(i), date="", tokens=["product x"], first=False, second=False, scope=[])


def test_a_new_key_writes_only_what_counts_and_leaves_by_one_timer():
    timers, stores = set(), {}
    handle = SimpleNamespace(getMapState=lambda name, *_: stores.setdefault(name, Store()), registerTimer=timers.add, deleteTimer=timers.discard, listTimers=lambda: iter(sorted(timers)))
    memory = EventMemory()
    memory.init(handle)
    out = list(memory.handleInputRows(("technical", "c", "x"), iter([row(i, 100 + i) for i in range(30)]), None))
    assert [r.dup_status for r in out] == ["unique"] + ["material_update"] * 29
    assert sorted(stores["entries"].held) == sorted((f"f{i}",) for i in range(22, 30)) and len(stores["posted"].held[("product x",)][0]) == 8
    assert sum(s.calls for s in stores.values()) <= 8 + 1 + 1 and len(timers) == 1
    # a day later the entries that are over are gone, and the next one has its timer; much later all are
    for late in (86_400_000, 40 * 86_400_000):
        at = timers.pop()
        now = SimpleNamespace(getExpiryTimeInMs=lambda at=at: at), SimpleNamespace(getCurrentWatermarkInMs=lambda at=at, late=late: at + late)
        list(memory.handleExpiredTimer(("technical", "c", "x"), now[1], now[0]))
        assert bool(stores["entries"].held) == bool(timers) and len(stores["entries"].held) == (6 if late == 86_400_000 else 0)
    assert not stores["posted"].held
