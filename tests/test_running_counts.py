import pandas as pd

from tidemill.streaming import runs


class State:
    exists, get = True, (5,)

    def update(self, value):
        self.get = value


def test_counts_leave_frame_by_frame():
    read, state = [], State()

    def frames():
        for ids in ([3, 1], [2]):
            read.append(ids)
            yield pd.DataFrame({"event_id": ids})

    found = runs._counted("grp", "event_id")(("k",), frames(), state)
    first = next(found)
    assert len(read) == 1 and first.values.tolist() == [["k", 1, 6], ["k", 3, 7]]
    assert next(found).values.tolist() == [["k", 2, 8]] and next(found, None) is None and state.get == (8,)
