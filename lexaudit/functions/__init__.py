"""Column expressions (``Column -> Column``). Nothing here shuffles."""
