"""DataFrame operators, one module per area; none runs an action unless its docstring says so."""
