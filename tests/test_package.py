def test_import():
    import sheafray  # noqa: F401
