"""The mapping store: keyed, expiring state, as a batch plan and as a stream."""
