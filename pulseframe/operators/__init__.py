"""DataFrame transformations over daily states, actions, feedback and history."""
