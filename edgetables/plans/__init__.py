"""Multi-operator plans: propagation steps, the fixed-point loop, components."""
