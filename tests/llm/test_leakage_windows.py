from chatloom.llm.leakage import _windows


def test_windows_of_two_diagonals():
    # the second seed's window begins before the first one's
    assert _windows([(100, 0), (105, 60)], 80, 300) == [(37, 188)]
    assert _windows([(100, 0), (250, 40)], 80, 300) == [(92, 188), (202, 298)]
    assert _windows([], 50, 400) == []
