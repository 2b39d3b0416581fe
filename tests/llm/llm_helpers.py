"""Helpers of these tests."""


def rows_of(df):
    return df.collect()


def words(text):
    return (text or "").encode().lower().split()
