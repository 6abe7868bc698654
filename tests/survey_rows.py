"""The fixtures' day and times on it."""

import datetime as dt

D = dt.date(2024, 1, 18)


def ts(day_offset=0, h=10, m=0, s=0, us=0):
    d = D + dt.timedelta(days=day_offset)
    return dt.datetime(d.year, d.month, d.day, h, m, s, us)
