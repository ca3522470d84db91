"""DataFrame -> DataFrame operators, one module per family (B classify, C grants, D members, E logs)."""
