"""DataFrame operators: ``f(df, ...spec...) -> DataFrame``, plans only."""
